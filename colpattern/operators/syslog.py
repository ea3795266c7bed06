"""Syslog lines as Column expressions: fields, message classes, parameters, templates, rendering.

A line is `Mon D HH:MM:SS host service[pid]: message`. Everything is string functions and ordered
conditions, so parsing is projections without a shuffle; only the numbering of strings by first
appearance aggregates. A line is split once, into a column that the next projection uses
several times (so the optimiser leaves it in place), and the rest is found by positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colpattern.operators.rows import global_rank
from colpattern.storage import cut

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CLASSES = ("auth_fail", "check_pass", "sess_open", "sess_close", "ftp_conn", "ftp_timeout", "svc_status", "logrotate", "syslog_restart", "snmp", "kerberos", "other")
#: White space as regular expressions have it.
_SPACE = " \t\n\x0b\f\r"


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    """A group of the first match, or null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def words(line: Column) -> Column:
    """The first four words of a line and what follows them."""
    return F.split(F.btrim(line, F.lit(_SPACE)), r"\s+", 5)


def fields(line: Column) -> dict[str, Column]:
    """month, day, time, hostname, rest (service and message); all null where the line has fewer
    than five fields or no day."""
    return fields_of(words(line))


def fields_of(w: Column) -> dict[str, Column]:
    """The same from the words of a line."""
    day = F.get(w, 1)
    day = F.when((F.size(w) == 5) & day.rlike(r"^\+?[0-9]+$"), day.try_cast("int"))
    ok = day.between(0, 255)
    out = {n: F.when(ok, F.get(w, k)) for n, k in (("month", 0), ("time", 2), ("hostname", 3), ("rest", 4))}
    return {"month": out["month"], "day": F.when(ok, day), "time": out["time"], "hostname": out["hostname"], "rest": out["rest"]}


def service(rest: Column) -> dict[str, Column]:
    """service, pid and message of `service[pid]: message`; null without a colon. A pid that is no
    number is null."""
    has = rest.contains(":")
    head = F.substring_index(rest, ":", 1)
    start = F.instr(head, "[")
    end = F.position(F.lit("]"), head, start + 1)
    bracket = (start > 0) & (end > 0)
    pid = F.substring(head, start + 1, end - start - 1)
    pid = F.when(pid.rlike(r"^\+?[0-9]+$"), pid.try_cast("bigint"))
    return {
        "service": F.when(has, F.when(bracket, F.substring(head, F.lit(1), start - 1)).otherwise(head)),
        "pid": F.when(has & bracket & (pid <= 4294967295), pid),
        "message": F.when(has, F.ltrim(F.substring(rest, F.length(head) + 2, F.length(rest)), F.lit(_SPACE))),
    }


def split_lines(lines: DataFrame, column: str) -> DataFrame:
    """lines that are not blank with _month, _day, _time, _hostname, _rest, _service, _pid, _message."""
    t = lines.withColumn("_words", words(F.col(column))).where(F.col("_words")[0] != "")
    t = t.withColumns({f"_{k}": v for k, v in fields_of(F.col("_words")).items()}).drop("_words")
    return t.withColumns({f"_{k}": v for k, v in service(F.col("_rest")).items()})


def classify(m: Column) -> Column:
    """The class of a message; the first test that holds decides."""
    return (
        F.when(m.startswith("authentication failure"), "auth_fail").when(m.startswith("check pass"), "check_pass")
        .when(m.startswith("session opened"), "sess_open").when(m.startswith("session closed"), "sess_close")
        .when(m.startswith("connection from"), "ftp_conn").when(m.contains("timed out"), "ftp_timeout")
        .when(m.contains("startup succeeded") | m.contains("shutdown succeeded"), "svc_status")
        .when(m.startswith("ALERT exited abnormally"), "logrotate").when(m.contains("restart"), "syslog_restart")
        .when(m.startswith("Received SNMP"), "snmp").when(m.contains("Kerberos") | m.contains("Authentication failed from"), "kerberos")
        .when(m.isNotNull(), "other")
    )


def parameter(m: Column, key: str) -> Column:
    """The value of `key=` in a message: of the first word that begins so, else of the first place where
    it stands; null if that is empty."""
    word = m.rlike(rf"(^|\s){key}=")
    return F.when(word, _group(m, rf"(?:^|\s){key}=(\S*)")).otherwise(_group(m, rf"{key}=(\S*)"))


def parameters(m: Column) -> dict[str, Column]:
    """The parameters of an authentication failure (null in other messages)."""
    ok = m.startswith("authentication failure")
    return {k: F.when(ok, parameter(m, k)) for k in ("rhost", "user", "uid", "euid", "tty", "ruser")}


def extracts(m: Column, kind: Column | None = None) -> dict[str, Column]:
    """What the other classes carry: session user, address and name of a peer, exit code, status. kind: the
    class of the message, where it is known."""
    kind = classify(m) if kind is None else kind
    ftp = F.regexp_extract(m, r"connection from ([^ (]*)", 1)
    return {
        "session_user": F.when(kind.isin("sess_open", "sess_close") & m.contains("for user "), F.regexp_extract(m, r"for user ([^ ]*)", 1)),
        "ip": F.when((kind == "ftp_conn") & m.contains("connection from "), ftp).when((kind == "snmp") & m.contains("from "), F.regexp_extract(m, r"from ([^ ]*)", 1)).when((kind == "kerberos") & m.contains("from "), F.regexp_extract(m, r"from ([^ (]*)", 1)),
        "resolved_host": F.when((kind == "ftp_conn") & m.contains("connection from "), _group(m, r"connection from [^(]*\(([^)]*)\)")),
        "exit_code": F.when(kind == "logrotate", F.regexp_extract(m, r"\[([+-]?[0-9]+)\]", 1).try_cast("int")),
        "status": F.when(kind == "svc_status", F.when(m.contains("startup"), "startup").otherwise("shutdown")),
    }


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with month, day, time, hostname, service, pid, msg_type, rhost, user and message. A line
    that is none has msg_type parse_error and itself as message; blank lines go."""
    t = split_lines(lines, column)
    m = F.col("_message")
    t = t.withColumn("_kind", classify(m))
    ok, kind = m.isNotNull(), F.col("_kind")
    user = F.coalesce(parameters(m)["user"], extracts(m, kind)["session_user"])
    out = {k: F.when(ok, F.col(f"_{k}")) for k in ("month", "day", "time", "hostname", "service", "pid")}
    out |= {"msg_type": F.coalesce(kind, F.lit("parse_error")), "rhost": parameters(m)["rhost"], "user": user, "message": F.when(ok, m).otherwise(F.btrim(F.col(column), F.lit(_SPACE)))}
    return t.withColumns(out).drop(*[c for c in t.columns if c.startswith("_") and c not in lines.columns])


def render(row: dict[str, Column]) -> Column:
    """A line from its fields; the day is two characters wide."""
    c = {k: F.coalesce(v, F.lit("")) for k, v in row.items() if k not in ("day", "pid")}
    pid = F.when(row["pid"].isNotNull(), F.concat(F.lit("["), row["pid"].cast("string"), F.lit("]"))).otherwise("")
    day = F.lpad(F.coalesce(row["day"], F.lit(0)).cast("string"), 2, " ")
    return F.concat(c["month"], F.lit(" "), day, F.lit(" "), c["time"], F.lit(" "), c["hostname"], F.lit(" "), c["service"], pid, F.lit(": "), c["message"])


def _value(m: Column, key: str) -> Column:
    """The word after the first `key`, white space between them skipped (so of `ruser= rhost=X` the
    value of `user=` is `rhost=X`, as the compact form defines it)."""
    return _group(m, rf"{key}\s*(\S*)")


def template(m: Column, strict: bool = False) -> dict[str, Column]:
    """code (one letter), v1 and v2 of a message: the compact form's classes, whose tests come in an
    order of their own. strict reads `user=` only as a word's beginning."""
    code = (
        F.when(m.startswith("authentication failure"), "A").when(m.startswith("check pass"), "C").when(m.startswith("session opened"), "O")
        .when(m.startswith("session closed"), "X").when(m.startswith("connection from"), "F").when(m.contains("ALERT exited abnormally"), "L")
        .when(m.contains("shutdown succeeded"), "D").when(m.contains("startup succeeded"), "U").when(m.contains("restart"), "R")
        .when(m.startswith("Received SNMP"), "S").when(m.contains("Kerberos") | m.contains("Authentication failed from"), "K")
        .when(m.contains("timed out") | m.contains("User unknown"), "T").when(m.contains("cupsd"), "P").otherwise("?")
    )
    session = F.when(m.contains("for user "), F.regexp_extract(m, r"for user ([^ ]*)", 1))
    ip = F.when(m.contains("connection from "), F.regexp_extract(m, r"connection from ([^ (]*)", 1))
    user = parameter(m, "user") if strict else _value(m, "user=")
    v1 = F.when(code == "A", _value(m, "rhost=")).when(code.isin("O", "X"), session).when(code == "F", ip).when(code == "S", _value(m, "from "))
    return {"code": code, "v1": v1, "v2": F.when(code == "A", user)}


def _clock(t: Column) -> dict[str, Column]:
    ok = t.rlike(r"^\+?[0-9]+:\+?[0-9]+:\+?[0-9]+$")
    parts = F.split(t, ":")
    return {n: F.when(ok, F.get(parts, k).try_cast("int")) for k, n in enumerate(("hour", "minute", "second"))}


def compact(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with mon, day, hour, minute, second, service, pid, code, v1, v2 and parsed, which is false
    where the line is none (then all are null and the code is `?`)."""
    t = split_lines(lines, column)
    t = t.withColumns({f"_{k}": v for k, v in _clock(F.col("_time")).items()})
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.col("_month")) - 1
    ok = F.col("_message").isNotNull() & (month >= 0) & F.col("_hour").between(0, 255) & F.col("_minute").between(0, 255) & F.col("_second").between(0, 255)
    ok = F.coalesce(ok, F.lit(False))
    tpl = template(F.col("_message"))
    out = {"mon": month.cast("int"), "day": F.col("_day"), "hour": F.col("_hour"), "minute": F.col("_minute"), "second": F.col("_second"), "service": F.col("_service"), "pid": F.col("_pid"), "v1": tpl["v1"], "v2": tpl["v2"]}
    t = t.withColumn("parsed", ok).withColumns({k: F.when(F.col("parsed"), v) for k, v in out.items()} | {"code": F.when(F.col("parsed"), tpl["code"]).otherwise("?")})
    return t.drop(*[c for c in t.columns if c.startswith("_")])


def intern(df: DataFrame, column: str, rid: str = "rid") -> DataFrame:
    """(value, id): the distinct values numbered from 0 in the order of their first rows."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(rid).alias("_first"))
    return global_rank(first, ["_first", "value"], "id").select("value", "id")


def compact_ids(lines: DataFrame, column: str = "line", rid: str = "rid") -> DataFrame:
    """(rid, mon, day, hour, minute, second, svc, pid, code, var1, var2): the compact form with service, v1
    and v2 as numbers. (Names of one letter would clash: m and M are one column to Spark.)"""
    t = cut(compact(lines, column))
    for name, out in (("service", "svc"), ("v1", "var1"), ("v2", "var2")):
        ids = intern(t, name, rid).withColumnsRenamed({"value": f"_{name}", "id": out})
        t = t.join(ids, F.col(name) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return t.select(rid, "mon", "day", "hour", "minute", "second", "svc", "pid", "code", "var1", "var2")


def codec(lines: DataFrame, keys: Sequence[str] = ("chunk",), column: str = "line", rid: str = "rid") -> DataFrame:
    """(*keys, document) of each chunk of lines: tables of services, addresses and users and ten
    run-length coded columns. Host and message text and lines that are none are dropped, as the
    form defines; `rid` gives the order within the keys. A document is one text and so one task's work: lines are
    shuffled once, by the keys, and each chunk is coded in one Arrow pass."""
    t = compact(lines, column).where("parsed")
    kind = F.col("code")
    ip, user = F.when(kind.isin("A", "F", "S"), F.col("v1")), F.when(kind == "A", F.col("v2")).when(kind.isin("O", "X"), F.col("v1"))
    t = t.select(*keys, rid, *_CODED[:5], "service", "pid", F.when(kind == "P", "?").otherwise(kind).alias("code"), ip.alias("_ip"), user.alias("_user"))
    names = ", ".join(f"`{k}` {t.schema[k].dataType.simpleString()}" for k in keys)
    return t.groupBy(*keys).applyInArrow(_coded_chunk(list(keys), rid), f"{names}, document string")


_CODED = ("mon", "day", "hour", "minute", "second", "service", "pid", "code", "_ip", "_user")


def _runs(values: list[str]) -> str:
    """Run-length coded values, as `rle_encode` writes them."""
    return "".join(f"{v}*{n} " if n > 2 else f"{v} " * n for v, n in ((v, sum(1 for _ in g)) for v, g in groupby(values)))


def _coded_chunk(keys: list[str], rid: str):
    """The function for applyInArrow over the parsed lines of a key."""

    def run(t):
        import pyarrow as pa

        t = t.sort_by(rid)
        tables, body = [], []
        for name, column in zip("mdHMSsptiu", _CODED, strict=True):
            values = t.column(column).to_pylist()
            if column in ("service", "_ip", "_user"):
                ids = {v: k for k, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
                tables.append("|".join(ids))
                values = [ids.get(v) for v in values]
            none = "-" if name == "p" else "-1"
            body.append(f"@{name}:" + _runs([none if v is None else str(v) for v in values]) + "\n")
        head = "".join(f"${tag}:{words}\n" for tag, words in zip("SIU", tables, strict=True))
        return pa.table({k: t.column(k).combine_chunks().slice(0, 1) for k in keys} | {"document": ["!L1\n" + head + "".join(body)]})

    return run

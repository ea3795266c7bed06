"""Inputs that several queries share, as the same expressions in both engines.

Real columns rarely follow patterns and no table holds log lines, so these are derived from the
whole of `events`; `{str}` stands for the text type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colpattern.catalog.registry import table


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duck_list(items: Sequence[str]) -> str:
    return "[" + ", ".join(map(quote, items)) + "]"


def pick(items: Sequence[str], index: Column) -> Column:
    """The index-th (from 0, modulo their number) of some texts."""
    return F.element_at(F.array(*map(F.lit, items)), (index % len(items) + 1).cast("int"))


# ------------------------------------------------ texts to be typed and escaped
FIELDS = ("42", " 42 ", "3.14", "1e3", "true", "NO", "y", "", " hello ", "-7", "+5", "007", "1.", ".5", "inf", "NaN", "1d", "9223372036854775808", "T", "False", "hello", "\\0", "\\e", "-", "a b", "-2.50", "f", "0")
_FIELD_DUCK = f"CASE event_id % 3 WHEN 0 THEN {duck_list(FIELDS)}[(event_id // 3) % {len(FIELDS)} + 1] WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE event_type END"
FIELDS_SQL = f"f AS (SELECT event_id, {_FIELD_DUCK} AS t FROM events)"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t): texts of all kinds."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, pick(FIELDS, F.floor(F.col("event_id") / 3))).when(k == 1, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return e.select("event_id", text.alias("t"))


INTEGER_SQL = "'^[+-]?[0-9]+$'"
FLOAT_SQL = r"'^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$'"
WORDS_SQL = "('true','yes','y','t','false','no','n','f')"


def kind_sql(t: str) -> str:
    """Kind of an SQL text expression that has been trimmed."""
    return f"CASE WHEN regexp_matches({t}, {INTEGER_SQL}) AND try_cast({t} AS BIGINT) IS NOT NULL THEN 'integer' WHEN regexp_matches({t}, {FLOAT_SQL}) THEN 'float' WHEN lower({t}) IN {WORDS_SQL} THEN 'boolean' ELSE 'string' END"


SPECIALS = ("a>b", "x*y~z", "p|q", "_0", "#h", "$d", "k:v", "back\\slash", "two\nlines", "tab\tx", "cr\rx", "sp ace", "plain", "(par)", "", "\\0", "\\e", "ümläut", "日本>語", "2024-01-01", "ends\\", "esc\\>ok", "q\\qq")
SPECIALS_SQL = f"s AS (SELECT event_id, CASE WHEN event_id % 29 = 28 THEN NULL WHEN event_id % 2 = 0 THEN {duck_list(SPECIALS)}[(event_id // 2) % {len(SPECIALS)} + 1] ELSE {duck_list(SPECIALS)}[(event_id // 2) % {len(SPECIALS)} + 1] || event_type END AS t FROM events)"


def specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t): texts with characters that need escapes, some null."""
    e = table(spark, sf_dir, "events")
    own = pick(SPECIALS, F.floor(F.col("event_id") / 2))
    text = F.when(F.col("event_id") % 29 == 28, F.lit(None)).when(F.col("event_id") % 2 == 0, own).otherwise(F.concat(own, F.col("event_type")))
    return e.select("event_id", text.alias("t"))


# ------------------------------------------------ columns with patterns
COLUMNS = {
    "seq": "CAST(event_id AS {str})",
    "arith": "CAST(event_id * 10 + 5 AS {str})",
    "down": "CAST(1000000 - 2 * event_id AS {str})",
    "mod25": "CAST(event_id % 25 AS {str})",
    "onoff": "CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END",
    "color": "CASE event_id % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'red' WHEN 3 THEN 'blue' ELSE 'white' END",
    "flag": "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END",
    "const": "'active'",
    "etype": "event_type",
    "usr": "CAST(user_id AS {str})",
    "blocks": "CASE WHEN event_id % 20 % 3 = 0 THEN 'aa' WHEN event_id % 20 % 3 = 1 THEN 'bb' ELSE 'cc' END",
}
_UNION = " UNION ALL ".join(f"SELECT {k} AS col_idx, '{n}' AS col_name, event_id AS rid, {e.format(str='VARCHAR')} AS v FROM events" for k, (n, e) in enumerate(COLUMNS.items()))
CELLS_SQL = f"c AS ({_UNION})"
STRINGS = ("onoff", "color", "flag", "const", "etype", "blocks")


def cells(spark: SparkSession, sf_dir: str, names: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
    """(col_idx, col_name, rid, kind, v) of the derived columns."""
    e = table(spark, sf_dir, "events")
    all_ = list(COLUMNS)
    items = [F.struct(F.lit(all_.index(n)).alias("col_idx"), F.lit(n).alias("col_name"), F.lit("string" if n in STRINGS else "integer").alias("kind"), F.expr(COLUMNS[n].format(str="STRING")).alias("v")) for n in names]
    return e.select(F.col("event_id").alias("rid"), F.explode(F.array(*items)).alias("x")).select("x.col_idx", "x.col_name", "rid", "x.kind", "x.v")


# ------------------------------------------------ log lines
_IP = "'10.0.' || CAST(user_id AS {str}) || '.7'"
_MESSAGES = (
    ("sshd(pam_unix)[' || CAST(19000 + user_id AS {str}) || ']", f"'authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=' || {_IP} || '  user=root'"),
    ("sshd(pam_unix)[' || CAST(19000 + user_id AS {str}) || ']", f"'authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=' || {_IP}"),
    ("sshd(pam_unix)[' || CAST(19000 + user_id AS {str}) || ']", "'check pass; user unknown'"),
    ("su(pam_unix)[21416]", "'session opened for user u' || CAST(user_id % 7 AS {str}) || ' by (uid=0)'"),
    ("su(pam_unix)[21416]", "'session closed for user u' || CAST(user_id % 7 AS {str})"),
    ("ftpd[24085]", f"'connection from ' || {_IP} || ' (host' || CAST(user_id AS {{str}}) || '.example.org) at Mon'"),
    ("ftpd[24085]", f"'connection from ' || {_IP} || ' () at Mon'"),
    ("ftpd[bad]", "'User unknown timed out after 900 seconds'"),
    ("cups", "'cupsd shutdown succeeded'"),
    ("syslog", "'syslogd startup succeeded'"),
    ("logrotate", "'ALERT exited abnormally with [1]'"),
    ("syslogd 1.4.1", "'restart.'"),
    ("snmpd[2318]", f"'Received SNMP packet(s) from ' || {_IP}"),
    ("klogind[1234]", f"'Authentication failed from ' || {_IP} || ' (10.9.9.9): Software caused connection abort'"),
    ("kernel", "'Linux version 2.6.5 ' || event_type"),
)


def _line(text: str) -> str:
    day = "event_id % 28 + 1"
    mon = "CASE event_id % 3 WHEN 0 THEN 'Jun' WHEN 1 THEN 'Jul' ELSE 'Dec' END"
    two = [f"lpad(CAST({x} AS {{str}}), 2, '0')" for x in ("event_id % 24", "event_id % 60", "event_id % 59")]
    cases = " ".join(f"WHEN {k} THEN '{s}: ' || {m}" for k, (s, m) in enumerate(_MESSAGES))
    body = f"CASE user_id % {len(_MESSAGES)} {cases} END"
    good = f"{mon} || ' ' || lpad(CAST({day} AS {{str}}), 2, ' ') || ' ' || {' || chr(58) || '.join(two)} || ' combo ' || {body}"
    return f"CASE WHEN event_id % 31 = 30 THEN 'garbage ' || event_type WHEN event_id % 31 = 29 THEN 'Jun xx 10:00:00 combo no day: ' || event_type WHEN event_id % 31 = 28 THEN 'Jun 5 10:00:00 combo without colon' ELSE {good} END".format(str=text)


LINES_SQL = f"l AS (SELECT event_id AS rid, {_line('VARCHAR')} AS line FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, line): log lines of every class, some of them broken."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), F.expr(_line("STRING")).alias("line"))


# ------------------------------------------------ whole documents
_LITERAL = r"""CASE WHEN regexp_matches(v, '[()]') OR (regexp_matches(v, '^[-!0-9]') AND NOT regexp_matches(v, '{plain}')) THEN CASE WHEN regexp_matches(v, '^[-!0-9]') THEN '\q' ELSE '' END
    || regexp_replace(regexp_replace(v, '([>*~|_#$:\\ ])', '\\\1', 'g'), '([()])', '\\\1', 'g') ELSE regexp_replace(v, '([>*~|_#$:\\ ])', '\\\1', 'g') END"""
PLAIN_INTEGER, PLAIN_FLOAT = r"^(0|-?[1-9][0-9]{0,17})$", r"^-?(0|[1-9][0-9]{0,5})\.[0-9]{0,8}[1-9]$|^-?[1-9][0-9]{0,8}\.[0-9]{0,5}[1-9]$"


def documents_sql(source: str, columns: Sequence[tuple[str, str, str]], chunk: str, rid: str) -> str:
    """The steps (without WITH) to y, a row for each column of each document, and docs (chunk, format, document,
    original_size, encoded_size, ratio), for tables whose columns are ranges, repeats or nothing.
    columns: (name, kind, text expression). Written over rows and not as the library does it."""
    cells = " UNION ALL ".join(f"SELECT ({chunk})::BIGINT AS chunk, {k} AS col_idx, '{n}' AS col_name, '{kind}' AS kind, ({rid})::BIGINT AS rid, CASE WHEN ({t}) IS NULL THEN '\\0' WHEN ({t}) = '' THEN '\\e' ELSE {t} END AS v FROM {source}" for k, (n, kind, t) in enumerate(columns))
    lit = _LITERAL.format(plain=f"{PLAIN_INTEGER}|{PLAIN_FLOAT}")
    return f"""dc AS ({cells}), de AS (SELECT *, {lit} AS lit, try_cast(v AS BIGINT) AS num FROM dc),
    df AS (SELECT chunk, v, count(*) AS n FROM dc WHERE kind = 'string' GROUP BY chunk, v HAVING count(*) > 1), dr AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n DESC, v) - 1 AS i FROM df),
    ds AS (SELECT chunk, v, i, strlen(v) * n - (strlen(v) + 1 + (1 + length(CAST(i AS VARCHAR))) * n) AS s FROM dr), dd AS (SELECT chunk, v, row_number() OVER (PARTITION BY chunk ORDER BY s DESC, i) - 1 AS idx FROM ds WHERE s > 0),
    dl AS (SELECT chunk, string_agg(v, '|' ORDER BY idx) AS words FROM dd GROUP BY chunk),
    dg AS (SELECT *, num - lag(num) OVER (PARTITION BY chunk, col_idx ORDER BY rid) AS gap FROM de LEFT JOIN dd USING (chunk, v)),
    dh AS (SELECT chunk, col_idx, col_name, count(*) AS n, sum(strlen(v) + 1)::BIGINT + strlen(col_name) AS input_bytes, sum(strlen(v)) + count(*) - 1 AS size, bool_or(lit LIKE '\\q%' OR contains(v, '(') OR contains(v, ')')) AS bad, count(idx) AS refs,
        string_agg(coalesce('_' || idx, lit), ' ' ORDER BY rid) AS raw, string_agg(lit, ' ' ORDER BY rid) AS plain, arg_min(num, rid) AS a, arg_max(num, rid) AS b, min(gap) AS g, min(gap) = max(gap) AND count(num) = count(*) AND min(gap) <> 0 AS even, min(v) = max(v) AS same, min(lit) AS one,
        count_if(regexp_matches(lit, '{PLAIN_INTEGER}')) AS ints, count_if(regexp_matches(lit, '{PLAIN_FLOAT}')) AS floats, count_if(idx IS NULL AND regexp_matches(lit, '{PLAIN_INTEGER}')) AS own_ints, count_if(idx IS NULL AND regexp_matches(lit, '{PLAIN_FLOAT}')) AS own_floats FROM dg GROUP BY chunk, col_idx, col_name),
    di AS (SELECT *, CASE WHEN n >= 3 AND even THEN a || '>' || b || CASE WHEN g = CASE WHEN b >= a THEN 1 ELSE -1 END THEN '' ELSE ':' || g END WHEN n >= 3 AND same THEN one || '*' || n END AS op FROM dh),
    y AS (SELECT * EXCLUDE (op), CASE WHEN size > strlen(op) THEN op END AS op FROM di),
    dj AS (SELECT chunk, string_agg('#' || col_name, ' ' ORDER BY col_idx) AS names, string_agg(coalesce(op, raw), '|' ORDER BY col_idx) AS body, string_agg(plain, '|' ORDER BY col_idx) AS plain, bool_or(bad) AS bad, sum(input_bytes)::BIGINT AS original_size FROM y GROUP BY chunk),
    dk AS (SELECT chunk, names, plain, bad, original_size, CASE WHEN bad THEN '!x1' ELSE '!v1' END || chr(10) || coalesce('$default:' || words || chr(10), '') || names || chr(10) || body AS enc FROM dj LEFT JOIN dl USING (chunk)),
    docs AS (SELECT chunk, CASE WHEN original_size / strlen(enc)::DOUBLE < 1.2 THEN 'ctx' ELSE 'v1' END AS format, CASE WHEN original_size / strlen(enc)::DOUBLE < 1.2 THEN CASE WHEN bad THEN '!xctx' ELSE '!ctx' END || chr(10) || names || chr(10) || plain ELSE enc END AS document,
        original_size, strlen(enc)::BIGINT AS encoded_size, original_size / strlen(enc)::DOUBLE AS ratio FROM dk)"""


def number_sql(c: str) -> str:
    """A double as its digits, without a trailing `.0` (no exponents)."""
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"

"""Escaping and formatting as Column expressions, all of it in the JVM.

In a column's stream the characters > * ~ | _ # $ : \\ newline, tab, carriage return and space are
escaped with a backslash. Null is the token \\0 and the empty string the token \\e.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKEN, EMPTY_TOKEN = "\\0", "\\e"
_SPECIAL = r"[>*~|_#$:\\\n\t\r ]"


def lit(s: str) -> Column:
    return F.lit(s)


def escape(c: Column) -> Column:
    """Escape a value for a stream."""
    c = F.regexp_replace(c, r"([>*~|_#$:\\ ])", r"\\$1")
    for raw, name in (("\n", "n"), ("\t", "t"), ("\r", "r")):
        c = F.replace(c, lit(raw), lit("\\" + name))
    return c


def unescape(c: Column) -> Column:
    """Undo `escape`, left to right. The tokens \\0 and \\e within a text vanish; an unknown escape or
    a backslash at the end gives null (see `unescape_error`)."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\])"), F.lit(1))
    named = {"n": "\n", "t": "\t", "r": "\r", "0": "", "e": ""}

    def one(x: Column) -> Column:
        out = F.when(F.length(x) == 2, F.substring(x, 2, 1)).otherwise(x)
        for name, raw in named.items():
            out = F.when(x == lit("\\" + name), lit(raw)).otherwise(out)
        return out

    return F.when(unescape_error(c).isNull(), F.array_join(F.transform(parts, one), ""))


def unescape_error(c: Column) -> Column:
    """What is wrong with an escaped text, or null."""
    left = F.regexp_replace(c, r"(?s)\\[>*~|_#$:\\ntr0e ]|[^\\]+", "")
    dangling = F.regexp_replace(c, r"(?s)\\.", "").endswith("\\")
    return F.when(dangling, lit("the text ends within an escape")).when(left != "", lit("no such escape"))


def is_null_token(c: Column) -> Column:
    return c == lit(NULL_TOKEN)


def is_empty_token(c: Column) -> Column:
    return c == lit(EMPTY_TOKEN)


def encode_value(c: Column) -> Column:
    """Null and the empty string as their tokens, everything else escaped."""
    return F.when(c.isNull(), lit(NULL_TOKEN)).when(c == "", lit(EMPTY_TOKEN)).otherwise(escape(c))


def decode_value(c: Column) -> Column:
    return F.when(is_null_token(c), F.lit(None).cast("string")).when(is_empty_token(c), lit("")).otherwise(unescape(c))


def needs_escaping(c: Column) -> Column:
    return c.rlike(_SPECIAL)


def escape_dictionary(c: Column) -> Column:
    """Escape a dictionary value: only the bar, line ends and the backslash."""
    for raw, out in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, lit(raw), lit(out))
    return c


def escape_name(c: Column) -> Column:
    """Escape a column name of a schema line."""
    for raw, out in (("\\", "\\\\"), (" ", "\\ "), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("#", "\\#")):
        c = F.replace(c, lit(raw), lit(out))
    return c


def format_bytes(c: Column) -> Column:
    """A size in readable form: 512 B, 1.50 KB. c: a whole number, of 64 bits or a decimal."""
    units = ("B", "KB", "MB", "GB", "TB")
    n = c.try_cast("bigint")
    out = F.format_string("%.2f TB", F.bround(n / float(1024**4), 2))
    for k in (3, 2, 1):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.2f {units[k]}", F.bround(n / float(1024**k), 2))).otherwise(out)
    out = F.when(n < 1024, F.concat(n.cast("string"), lit(" B"))).otherwise(out)
    return F.when(n.isNull(), _terabytes(c)).otherwise(out)


def _terabytes(c: Column) -> Column:
    """A size beyond 64 bits, which a double would not carry to two digits: the hundredths are whole numbers,
    ties to the even one."""
    unit = F.lit(1024**4).cast("decimal(38,0)")
    c = c.cast("decimal(38,0)")
    whole = ((c - c % unit) / unit).cast("decimal(38,0)")
    left = (c % unit).cast("bigint") * 100
    hundredths, rest = F.floor(left / F.lit(1024**4)), left % 1024**4
    up = (rest > 1024**4 // 2) | ((rest == 1024**4 // 2) & (hundredths % 2 == 1))
    hundredths = hundredths + F.when(up, 1).otherwise(0)
    whole = F.when(hundredths == 100, whole + 1).otherwise(whole).cast("decimal(38,0)")
    return F.concat(whole.cast("string"), lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), lit(" TB"))

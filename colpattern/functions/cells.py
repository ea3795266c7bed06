"""Dynamically typed cells: a cell is a kind and a canonical text.

Kinds are null, integer (64 bit), float, boolean and string. Types belong to cells, not to
columns; a column's type is a summary of the kinds in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("null", "integer", "float", "boolean", "string")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "t"), ("false", "no", "n", "f")
#: Number texts; the casts of both engines accept more than these, so they are tested first.
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
_BLANK = " \t\r\n"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def as_integer(text: Column) -> Column:
    """A 64-bit integer, or null where the text is none."""
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def as_float(text: Column) -> Column:
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def parse_boolean(text: Column) -> Column:
    """true, false, or null where the text is neither (case does not matter)."""
    low = F.lower(text)
    return F.when(low.isin(*TRUE_WORDS, "1"), True).when(low.isin(*FALSE_WORDS, "0"), False)


def _kind(t: Column) -> Column:
    return F.when(as_integer(t).isNotNull(), "integer").when(as_float(t).isNotNull(), "float").when(F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS), "boolean").otherwise("string")


def csv_kind(text: Column) -> Column:
    """The kind of a CSV field: empty is null, then numbers and boolean words of the trimmed text."""
    return F.when(text.isNull() | (text == ""), "null").otherwise(_kind(trim(text)))


def csv_repr(text: Column, kind: Column | None = None) -> Column:
    """The canonical text of a CSV field, whose kind may be known; a string keeps its white space."""
    return _canonical(csv_kind(text) if kind is None else kind, trim(text), text)


def decoded_kind(text: Column) -> Column:
    """The kind of a decoded cell: the tokens for null and empty, then as above but untrimmed."""
    return F.when(text.isNull() | (text == "\\0") | (text == ""), "null").when(text == "\\e", "string").otherwise(_kind(text))


def decoded_text(text: Column) -> Column:
    """The text of a decoded cell: null, the empty string, or the canonical text."""
    kind = decoded_kind(text)
    return F.when(kind == "null", F.lit(None).cast("string")).when(text == "\\e", F.lit("")).otherwise(_canonical(kind, text, text))


def _canonical(kind: Column, number: Column, text: Column) -> Column:
    return (
        F.when(kind == "null", F.lit("\\0"))
        .when(kind == "integer", as_integer(number).cast("string"))
        .when(kind == "float", float_text(as_float(number)))
        .when(kind == "boolean", parse_boolean(number).cast("string"))
        .otherwise(F.when(text == "", F.lit("\\e")).otherwise(text))
    )


def float_text(d: Column, digits: Column | None = None) -> Column:
    """Digits of a double without exponent or trailing `.0`: 1, 0.0000000001, 10000000000000000."""
    s = d.cast("string") if digits is None else digits
    short = F.when(s.endswith(".0"), F.substring(s, F.lit(1), F.length(s) - 2)).otherwise(s)
    return F.when(F.isnan(d), "NaN").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").when(s.contains("E"), _without_exponent(s)).otherwise(short)


def _without_exponent(s: Column) -> Column:
    sign = F.when(s.startswith("-"), "-").otherwise("")
    whole, frac = F.regexp_extract(s, r"^-?([0-9]+)\.", 1), F.regexp_extract(s, r"\.([0-9]+)", 1)
    frac = F.when(frac == "0", "").otherwise(frac)
    e = F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.concat(whole, frac)
    big = F.when(F.length(frac) <= e, F.concat(digits, F.repeat(F.lit("0"), e - F.length(frac)))).otherwise(F.concat(F.substring(digits, F.lit(1), F.length(whole) + e), F.lit("."), F.substring(digits, F.length(whole) + e + 1, F.length(digits))))
    return F.concat(sign, F.when(e >= 0, big).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)))


def value_kind(c: Column, kind: T.DataType) -> Column:
    """The kind of a typed column's values."""
    name = "integer" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "float" if isinstance(kind, (T.FloatType, T.DoubleType)) else "boolean" if isinstance(kind, T.BooleanType) else "string"
    return F.when(c.isNull(), "null").otherwise(name)


def value_repr(c: Column, kind: T.DataType, digits: Column | None = None) -> Column:
    """The canonical text of a typed column's values. digits: the cast of a float's double to a string, if
    there is a column that has it."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c.isNull(), "\\0").otherwise(float_text(c.cast("double"), digits))
    text = F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    empty = F.when(text == "", "\\e").otherwise(text) if isinstance(kind, (T.StringType, T.BinaryType)) else text
    return F.when(c.isNull(), "\\0").otherwise(empty)


def typed(kind: Column, text: Column) -> dict[str, Column]:
    """Typed views of a cell; an integer widens to a float, anything else of the wrong kind is null."""
    return {
        "as_integer": F.when(kind == "integer", as_integer(text)),
        "as_float": F.when(kind.isin("integer", "float"), text.try_cast("double")),
        "as_string": F.when(kind == "string", F.when(text == "\\e", F.lit("")).otherwise(text)),
        "as_boolean": F.when(kind == "boolean", parse_boolean(text)),
    }


def column_type(kind: Column) -> Column:
    """Aggregate: the type of a column from its cells' kinds (nulls don't count). A string makes it a
    string, a float among numbers a float, any other mix is `mixed`; without values it is a string."""
    has = {k: F.coalesce(F.bool_or(kind == k), F.lit(False)) for k in KINDS[1:]}
    several = reduce(lambda a, b: a + b, [has[k].cast("int") for k in KINDS[1:]])
    return (
        F.when(several == 0, "string").when(has["string"], "string")
        .when(several == 1, F.when(has["integer"], "integer").when(has["float"], "float").otherwise("boolean"))
        .when(has["float"] & has["integer"], "float").otherwise("mixed")
    )


def can_represent(type_: Column, kind: Column) -> Column:
    """Whether a value of the kind fits a column of the type."""
    return (kind == "null") | (type_ == "mixed") | (type_ == kind) | ((type_ == "float") & (kind == "integer"))


def to_cells(df: DataFrame, rid: str = "rid", keys: tuple[str, ...] = (), infer: bool = False) -> DataFrame:
    """Long form of a table: (*keys, col_idx, col_name, rid, kind, v). With infer, string columns are
    read like CSV fields; else kinds follow the column types. No shuffle; what texts and kinds are made
    from is a projection of its own, so that it is worked out once for a value."""
    fields = [f for f in df.schema.fields if f.name not in (rid, *keys)]
    floats = {f"_digits{k}": F.col(f"`{f.name}`").cast("double").cast("string") for k, f in enumerate(fields) if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    kinds = {f"_kind{k}": csv_kind(F.col(f"`{f.name}`")) for k, f in enumerate(fields) if infer and isinstance(f.dataType, T.StringType)}
    items = []
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        if f"_kind{k}" in kinds:
            kind, v = F.col(f"_kind{k}"), csv_repr(c, F.col(f"_kind{k}"))
        else:
            kind, v = value_kind(c, f.dataType), value_repr(c, f.dataType, F.col(f"_digits{k}") if f"_digits{k}" in floats else None)
        items.append(F.struct(F.lit(k).alias("col_idx"), F.lit(f.name).alias("col_name"), kind.alias("kind"), v.alias("v")))
    out = df.select("*", *[c.alias(n) for n, c in (floats | kinds).items()]).select(*keys, F.col(rid).cast("long").alias("rid"), F.explode(F.array(*items)).alias("x"))
    return out.select(*keys, "x.col_idx", "x.col_name", "rid", "x.kind", "x.v")

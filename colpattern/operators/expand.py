"""Operators of column streams and their expansion to values.

A stream is rows (*keys, col_idx, op_idx, kind, repeats, text, start, end, step, values, count,
dict_idx): kind is raw, range, toggle or dict; nested repetition is a product, so `repeats` says
it all. An operator's length is an expression, its place in the column a running sum, and its
values are a function of the index, so expansion is one explode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most values of a range.
MAX_EXPANSION = 10_000_000
OPS = "col_idx int, op_idx int, kind string, repeats long, text string, start long, end long, step long, values array<string>, count long, dict_idx long"


def range_count(start: Column, end: Column, step: Column) -> Column:
    """Values that a range claims before it is expanded; a direction that doesn't fit counts as 1."""
    wide = "decimal(38,0)"
    diff = F.abs(end.cast(wide) - start.cast(wide))
    fits = F.when(end >= start, step > 0).otherwise(step < 0)
    return F.when(step == 0, F.lit(None)).when(fits, F.floor(diff / F.abs(step).cast(wide)) + 1).otherwise(1).cast("decimal(20,0)")


def check_range(start: Column, end: Column, step: Column, limit: int = MAX_EXPANSION) -> Column:
    """True, or an error where a range is empty of sense or too long."""
    count = range_count(start, end, step)
    bad = F.raise_error(F.concat(F.lit("range overflow: "), start.cast("string"), F.lit(">"), end.cast("string"), F.lit(":"), step.cast("string"))).cast("boolean")
    return F.when((step == 0) | (count > limit), bad).otherwise(True)


def base_count() -> Column:
    """Values of one repetition of an operator row."""
    start, end, step = F.col("start"), F.col("end"), F.col("step")
    fits = F.when(step > 0, end >= start).otherwise(end <= start)
    span = F.when(fits, F.floor(F.abs(F.try_subtract(end, start)) / F.abs(step)) + 1).otherwise(0)
    return F.when(F.col("kind") == "range", span).when(F.col("kind") == "toggle", F.when(F.size("values") > 0, F.col("count")).otherwise(0)).otherwise(1).cast("long")


def expanded_count() -> Column:
    """Values of an operator row."""
    return (base_count() * F.greatest(F.col("repeats"), F.lit(0))).cast("long")


def value_at(j: Column, dictionary: Column | None = None) -> Column:
    """The j-th value (from 0) of an operator row. A reference outside the dictionary is an error."""
    i = F.pmod(j, F.greatest(base_count(), F.lit(1)))
    at = (F.pmod(i, F.greatest(F.size("values"), F.lit(1))) + 1).cast("int")
    if dictionary is None:
        ref = F.raise_error(F.lit("dictionary reference without a dictionary")).cast("string")
    else:
        ref = F.coalesce(F.try_element_at(dictionary, (F.col("dict_idx") + 1).cast("int")), F.raise_error(F.concat(F.lit("invalid dictionary reference _"), F.col("dict_idx").cast("string"))).cast("string"))
    return (
        F.when(F.col("kind") == "range", (F.col("start") + i * F.col("step")).cast("string"))
        .when(F.col("kind") == "toggle", F.element_at("values", at))
        .when(F.col("kind") == "dict", ref)
        .otherwise(F.col("text"))
    )


def expand(ops: DataFrame, keys: Sequence[str] = (), dictionary: str | None = None, limit: int = MAX_EXPANSION) -> DataFrame:
    """(*keys, col_idx, rid, v): the values of each stream in order of its operators. An operator of more
    than `limit` values, repetitions counted in, is an error."""
    n = expanded_count()
    n = F.when(n > limit, F.raise_error(F.concat(F.lit("an operator has too many values: "), n.cast("string"))).cast("long")).otherwise(n)
    placed = ops.withColumn("_n", n).withColumn("_from", F.sum("_n").over(Window.partitionBy(*keys, "col_idx").orderBy("op_idx")) - F.col("_n"))
    rows = placed.where("_n > 0").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    v = value_at(F.col("_j"), F.col(dictionary) if dictionary else None)
    return rows.select(*keys, "col_idx", (F.col("_from") + F.col("_j")).alias("rid"), v.alias("v"))


def validate(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, columns, rows, valid): whether all columns of a document have the same length."""
    per = ops.groupBy(*keys, "col_idx").agg(F.sum(expanded_count()).alias("n"))
    return per.groupBy(*keys).agg(F.count("*").alias("columns"), F.max("n").alias("rows"), (F.min("n") == F.max("n")).alias("valid"))


def pivot(values: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, rid, *names): the table of a document whose columns have been expanded."""
    return values.groupBy(*keys, "rid").agg(*[F.max(F.when(F.col("col_idx") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def info(ops: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, ranges, multipliers, toggles, dict_refs, raw_values): operators by kind; a repeated one
    counts as a multiplier and by its own kind."""
    def count(c: Column, name: str) -> Column:
        return F.count_if(c).cast("long").alias(name)

    kind = F.col("kind")
    parts = [count(kind == "range", "ranges"), count(F.col("repeats") > 1, "multipliers"), count(kind == "toggle", "toggles"), count(kind == "dict", "dict_refs"), count(kind == "raw", "raw_values")]
    return ops.groupBy(*keys).agg(*parts) if keys else ops.agg(*parts)

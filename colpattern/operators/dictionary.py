"""The shared dictionary of frequent strings, and columns of few distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.functions.cells import parse_boolean
from colpattern.operators.rows import global_rank

MAX_ENTRIES = 65_536
MAX_DISTINCT = 16


def frequencies(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, v, n): how often each string value stands in any column; numbers don't count."""
    return cells.where("kind = 'string'").groupBy(*keys, "v").agg(F.count("*").alias("n"))


def reference_length(rank: Column) -> Column:
    """Characters of a reference to the entry of a rank: `_0` is 2, `_10` is 3."""
    return F.length(rank.cast("string")) + 1


def build(freq: DataFrame, keys: Sequence[str] = (), max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(*keys, v, n, bytes_saved, dict_idx) of the values that pay.

    Values that occur more than once are ranked by frequency (ties by value); an entry saves
    `bytes * n - (bytes + 1 + reference * n)`; those that save are numbered by that, at most
    max_entries of them. Without keys the ranking is distributed; the final numbering sees no
    more than max_entries rows.
    """
    often = freq.where("n > 1")
    by_count = [F.desc("n"), F.asc("v")]
    if keys:
        ranked = often.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy(*by_count)) - 1).cast("long"))
    else:
        ranked = global_rank(often, by_count, "i")
    size = F.octet_length("v").cast("long")
    saved = (size * F.col("n") - (size + 1 + reference_length(F.col("i")) * F.col("n"))).cast("long")
    paying = ranked.withColumn("bytes_saved", saved).where("bytes_saved > 0")
    order = [F.desc("bytes_saved"), F.asc("i")]
    if not keys:
        paying = paying.orderBy(*order).limit(max_entries)
    number = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    out = paying.withColumn("dict_idx", (F.row_number().over(number) - 1).cast("long"))
    return out.where(F.col("dict_idx") < max_entries).select(*keys, "v", "n", "bytes_saved", "dict_idx")


def savings(entries: DataFrame) -> DataFrame:
    """(entries, total_bytes_saved, has_benefit)."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).cast("long").alias("total_bytes_saved"), (F.count("*") > 0).alias("has_benefit"))


def encode(cells: DataFrame, entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """cells with dict_idx, null where the value has no entry. All columns are looked up, numbers
    too. Entries without keys are at most max_entries, so they are broadcast."""
    look = entries.select(*keys, "v", "dict_idx")
    return cells.join(look if keys else F.broadcast(look), [*keys, "v"], "left")


def boolean_columns(cells: DataFrame, keys: Sequence[str] = ("col_name",)) -> DataFrame:
    """(*keys, first, second) of the columns with exactly two values: the true form first if both are
    boolean words, else in order."""
    two = _distinct(cells, keys, 2).where(F.size("vs") == 2)
    a, b = F.col("vs")[0], F.col("vs")[1]
    swap = parse_boolean(a).isNotNull() & parse_boolean(b).isNotNull() & ~parse_boolean(a) & parse_boolean(b)
    return two.select(*keys, F.when(swap, b).otherwise(a).alias("first"), F.when(swap, a).otherwise(b).alias("second"))


def enum_columns(cells: DataFrame, keys: Sequence[str] = ("col_name",), max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """(*keys, members) of the columns with 2 to max_distinct values, in order."""
    return _distinct(cells, keys, max_distinct).where((F.size("vs") > 1) & (F.size("vs") <= max_distinct)).select(*keys, F.array_join("vs", "|").alias("members"))


def _distinct(cells: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The distinct values of each column, sorted; columns with more than `most` are left out before
    their values are gathered."""
    values = cells.select(*keys, "v").distinct()
    few = values.groupBy(*keys).count().where(F.col("count") <= most).drop("count")
    return values.join(few, list(keys), "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("vs"))


def all_boolean(cells: DataFrame, keys: Sequence[str] = ("col_name",)) -> DataFrame:
    """(*keys, is_boolean): whether every value is a boolean word."""
    return cells.groupBy(*keys).agg(F.bool_and(parse_boolean(F.col("v")).isNotNull()).alias("is_boolean"))

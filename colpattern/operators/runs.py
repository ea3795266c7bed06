"""Runs of equal values and arithmetic segments of a column (rid, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpattern.operators.rows import running_count, with_previous


def find_runs(df: DataFrame, least: int = 1, keys: Sequence[str] = (), column: str = "v", rid: str = "rid") -> DataFrame:
    """(*keys, run_start, run_value, run_count) of the runs of at least `least` equal values."""
    t = with_previous(df.select(*keys, rid, column), keys, column, "_prev", rid)
    t = running_count(t, keys, (F.col(rid) == 0) | ~F.col(column).eqNullSafe(F.col("_prev")), "_run", rid)
    out = t.groupBy(*keys, "_run").agg(F.min(rid).alias("run_start"), F.min(column).alias("run_value"), F.count("*").alias("run_count"))
    return out.where(F.col("run_count") >= least).drop("_run")


def longest_run(df: DataFrame, keys: Sequence[str] = (), column: str = "v", rid: str = "rid") -> DataFrame:
    """The longest run; of several the last."""
    best = F.max(F.struct("run_count", "run_start", "run_value")).alias("m")
    runs = find_runs(df, 1, keys, column, rid)
    out = runs.groupBy(*keys).agg(best) if keys else runs.agg(best).where("m is not null")
    return out.select(*keys, "m.run_start", "m.run_value", "m.run_count")


def arithmetic_segments(df: DataFrame, column: str = "v", rid: str = "rid") -> DataFrame:
    """(seg_start, seg_len, seg_step) of the maximal stretches with a constant difference; neighbours
    share the element between them. A single value is a segment of length 1 and step 0."""
    t = with_previous(df.select(rid, column), (), column, "_prev", rid)
    d = t.where(F.col(rid) > 0).select(F.col(rid), F.try_subtract(F.col(column), F.col("_prev")).alias("_d"))
    d = with_previous(d, (), "_d", "_last", rid)
    d = running_count(d, (), (F.col(rid) == 1) | ~F.col("_d").eqNullSafe(F.col("_last")), "_seg", rid)
    out = d.groupBy("_seg").agg((F.min(rid) - 1).alias("seg_start"), (F.count("*") + 1).alias("seg_len"), F.min("_d").alias("seg_step")).drop("_seg")
    alone = df.agg(F.count("*").alias("n")).where("n = 1").select(F.lit(0).cast("long").alias("seg_start"), F.lit(1).cast("long").alias("seg_len"), F.lit(0).cast("long").alias("seg_step"))
    return out.unionByName(alone)


def rle_encode(df: DataFrame, keys: Sequence[str] = (), column: str = "v", rid: str = "rid") -> DataFrame:
    """(*keys, encoded): runs of more than two values as `v*n`, others repeated, a space after each;
    null is `-`. One text per key, so meant for columns of chunks."""
    runs = find_runs(df, 1, keys, column, rid)
    text = F.coalesce(F.col("run_value").cast("string"), F.lit("-"))
    token = F.when(F.col("run_count") > 2, F.concat(text, F.lit("*"), F.col("run_count").cast("string"), F.lit(" "))).otherwise(F.repeat(F.concat(text, F.lit(" ")), F.col("run_count").cast("int")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("run_start", token.alias("token")))), lambda x: x["token"])
    joined = F.array_join(parts, "").alias("encoded")
    return runs.groupBy(*keys).agg(joined) if keys else runs.agg(joined)

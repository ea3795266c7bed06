"""Row indexes and neighbours without a single-task window.

Row order is part of the semantics here, and Spark rows have none, so tables carry a dense
`rid`. Ranks are taken per range partition and shifted by the sizes of the partitions before;
the previous row's value is looked up within blocks of rids and, at a block's edge, in the small
table of the blocks' last rows; running counts are added up block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.storage import cut

#: Rows of a block.
BLOCK = 1 << 18


def with_rid(df: DataFrame, order_by: Sequence[str | Column] = (), dense: str | None = None, name: str = "rid") -> DataFrame:
    """df with a dense row index: a column that is one already, or the rank in the given order.
    A table without either has no row order, which is an error."""
    if dense is not None:
        return df.withColumn(name, F.col(dense).cast("long"))
    if not order_by:
        raise ValueError("row order matters: pass order_by or a dense index column")
    return global_rank(df, order_by, name)


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rid") -> DataFrame:
    """df with its rank (from 0) in the given order, over all partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = s.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = s.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def with_previous(df: DataFrame, keys: Sequence[str], column: str, name: str, rid: str = "rid", block: int = BLOCK) -> DataFrame:
    """df with the value of `column` in the row before (by rid, within keys); null in the first row."""
    b = df.withColumn("_b", F.floor(F.col(rid) / block))
    edges = b.where(F.col(rid) % block == block - 1).select(*keys, (F.col("_b") + 1).alias("_b"), F.col(column).alias("_edge"))
    own = F.lag(column).over(Window.partitionBy(*keys, "_b").orderBy(rid))
    out = b.withColumn("_own", own).join(edges, [*keys, "_b"], "left")
    return out.withColumn(name, F.when(F.col(rid) % block == 0, F.col("_edge")).otherwise(F.col("_own"))).drop("_b", "_edge", "_own")


def running_count(df: DataFrame, keys: Sequence[str], flag: Column, name: str, rid: str = "rid", block: int = BLOCK) -> DataFrame:
    """df with the number of rows up to and including this one (by rid, within keys) where flag holds."""
    b = df.withColumns({"_b": F.floor(F.col(rid) / block), "_f": F.when(flag, 1).otherwise(0).cast("long")})
    sums = b.groupBy(*keys, "_b").agg(F.sum("_f").alias("_s"))
    before = sums.select(*keys, "_b", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")).alias("_before"))
    local = F.sum("_f").over(Window.partitionBy(*keys, "_b").orderBy(rid))
    return b.withColumn("_l", local).join(before, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_l")).drop("_b", "_f", "_l", "_before")

"""The registered queries: one per operator, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colpattern.catalog import codec_queries, pattern_queries, typing_queries  # noqa: F401  (they register their queries)
from colpattern.catalog.registry import ORACLE, QUERIES
from colpattern.functions.cells import to_cells
from colpattern.operators.encode import choose
from colpattern.operators.rows import with_rid


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col_name, pattern, operator, ratio): how each column of orders is best described."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cells = to_cells(with_rid(orders, dense="o_orderkey"))
    names = cells.select("col_idx", "col_name").distinct()
    return choose(cells).join(F.broadcast(names), "col_idx").select("col_name", "pattern", "operator", F.round("ratio", 6).alias("ratio"))

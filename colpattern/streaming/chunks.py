"""Chunked and micro-batch encoding. Each chunk is a document of its own; no row is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colpattern.config import EncodeConfig
from colpattern.plans import codec
from colpattern.sources.document import register

#: Rows of a chunk.
CHUNK_ROWS = 1000


def chunk_documents(df: DataFrame, order_by: Sequence[str | Column] = (), dense: str | None = None, chunk_rows: int = CHUNK_ROWS, infer: bool = False, config: EncodeConfig = EncodeConfig()) -> DataFrame:
    """(chunk, format, document, ...) of every chunk_rows rows in order."""
    return codec.compress(df, order_by, dense, chunk_rows, infer, config)


def write_stream(stream: DataFrame, path: str, checkpoint: str, order_by: Sequence[str | Column], chunk_rows: int = CHUNK_ROWS, config: EncodeConfig = EncodeConfig(), **trigger) -> StreamingQuery:
    """Encode a stream: each micro-batch is ordered, chunked and written to `path`/batch-<id>, which a
    repeated batch overwrites, so every row is written once."""

    def write(batch: DataFrame, ident: int) -> None:
        if not batch.isEmpty():
            docs = chunk_documents(batch, order_by, chunk_rows=chunk_rows, config=config)
            docs.select(F.lit(ident).alias("batch"), "*").write.mode("overwrite").parquet(f"{path}/batch-{ident:010d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents that write_stream has written, with chunk numbers that are unique over batches."""
    docs = spark.read.parquet(f"{path}/batch-*")
    return docs.withColumn("chunk", F.concat_ws("-", F.lpad(F.col("batch").cast("string"), 10, "0"), F.lpad(F.col("chunk").cast("string"), 10, "0")))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a folder of document files, by the `colpattern` format."""
    register(spark)
    return spark.readStream.format("colpattern").load(path)

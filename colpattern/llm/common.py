"""Shared pieces of the training-data operators: rows and their ids, memory, word hashing.

Words are maximal runs of bytes above 0x20 in the UTF-8 text; every other byte separates.
All hashing is vectorised over the Arrow string buffers, half a megabyte at a time, so a
worker's memory follows the chunk size and not the batch (one very long text is a chunk of
its own, hashed in blocks).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.storage import cut, fits_broadcast, fresh_path, maybe_broadcast  # noqa: F401  (the operators take them from here)

#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_HASH = np.random.default_rng(20_240_501).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


# ------------------------------------------------ tables
def modest_batches(spark: SparkSession) -> None:
    """Hand texts to Python 8 MB at a time unless the session says otherwise (the default is 64 MB
    for each of the JVM, the socket and the worker). The setting stays, as plans run later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(key, str(8 << 20))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """docs without repeated doc_ids (the row whose text sorts first stays) and without rows whose doc_id is
    null. Looks at the ids first: texts move only for ids that repeat."""
    return split_ids(docs)[0]


def split_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(a row for each doc_id, the rows of other texts under the same ids or None). Rows that share doc_id
    and text are one; rows whose doc_id is null are in neither."""
    known = docs.where(F.col("doc_id").isNotNull())
    again, t = fresh(docs, "_again"), fresh(docs, "_text")
    repeated = known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    if repeated.isEmpty():
        return known, None
    repeated = maybe_broadcast(cut(repeated))
    single = known.join(repeated, F.col("doc_id") == F.col(again), "left_anti")
    several = known.join(repeated, F.col("doc_id") == F.col(again), "left_semi")
    n = fresh(docs, "_nth")
    order = Window.partitionBy("doc_id", "text").orderBy(*[F.col(c).asc_nulls_last() for c in _sortable(docs)] or ["doc_id"])
    several = cut(several.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n))
    first = several.groupBy(F.col("doc_id").alias(again)).agg(F.min("text").alias(t))
    several = several.join(maybe_broadcast(first), F.col("doc_id") == F.col(again))
    least = F.col("text").eqNullSafe(F.col(t))
    return single.unionByName(several.where(least).drop(again, t)), several.where(~least).drop(again, t)


def _sortable(df: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in df.schema.fields if f.name not in ("doc_id", "text") and f.dataType.typeName() in ("string", "long", "integer", "double", "boolean")]


def text_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just (doc_id, text), so that no other column of the table can clash with ours."""
    modest_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def word_count(text: str | Column = "text") -> Column:
    """Words of a text by the definition above; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x00-\x20]+")), F.lit(0)).cast("long")


# ------------------------------------------------ memory of Python workers
def release() -> None:
    """Give freed memory back to the system: workers stay alive between tasks, and what they keep is
    taken from the JVM beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function over batches that releases memory when its task is done."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_udf(f):
    """The same for a function of columns, after each batch."""

    def wrapped(*columns: pa.Array) -> pa.Array:
        try:
            return f(*columns)
        finally:
            release()

    return wrapped


# ------------------------------------------------ hashing
def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n, self.pow, self.inv = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
                a = np.full(self.n + 1, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.pow, self.inv


_POWERS = _Powers()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if off is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_ranges(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes each; a longer row is alone in its range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of data; texts begin at offsets."""
    word = data > 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    pw, inv = _POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_HASH[data] * pw[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in blocks of CHUNK_BYTES."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        out.append(_hash_block(data[a:b], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(out)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, each row's first word) for chunks of rows."""
    data, offsets = buffers(texts)
    for i, j in row_ranges(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        part, off = data[a:b], offsets[i : j + 1] - a
        starts, ends = word_bounds(part, off)
        yield i, j, word_hashes(part, starts, ends), np.searchsorted(starts, off)


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of the windows of `width` words that begin at the given words."""
    pw, inv = _POWERS.get(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * pw[: len(words)], out=sums[1:])
    return mix((sums[at + width] - sums[at]) * inv[at] + _U((width * 0xD6E8FEB86659FD93 + salt) & _MASK))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

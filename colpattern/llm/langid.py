"""Language identification with a bit-sliced Bloom filter of byte n-grams.

One table of masks serves all languages: bit l of a slot belongs to the Bloom filter of
language l, so ANDing the slots of an n-gram's hashes returns the set of all languages that
contain the n-gram in one go. A document's per-language popcounts, divided by its n-grams and
corrected for each filter's false-positive rate, decide its language.

The filters are trained from the labelled rows of the table itself: at most `per_lang` rows of
each language (those with the smallest id hash), whose `grams` most frequent n-grams are kept.
That bound concerns training only; every document is classified over its whole text.

Defined results: a text that is null, empty or has no n-gram (fewer than four bytes, no
letters) is `und` with rate 0 and is rejected; with ties the language that sorts first wins;
repeated rows are classified alike; rows with a null doc_id are classified too; rows without
lang only don't train. Without any labelled row every document is `und`. An empty table gives
an empty result. More than 64 languages take several masks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.llm.common import batch, buffers, cut, maybe_broadcast, modest_batches, row_ranges, text_of, tidy, tidy_udf

#: Labelled rows of each language that train its filter.
PER_LANG = 1000
#: Most frequent n-grams of each language that its filter holds.
GRAMS = 16_384
#: log2 of the slots, and hash functions of each filter.
SLOT_BITS, HASHES = 18, 3
#: Languages of a mask.
WORD = 64
#: A document whose best corrected rate is below this is rejected.
MIN_RATE = 0.25

_LOWER = np.full(256, 32, np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)
RESULT = "struct<lang:string,rate:double,n_grams:bigint>"
_RESULT = pa.struct([("lang", pa.string()), ("rate", pa.float64()), ("n_grams", pa.int64())])


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-byte grams as uint32, each text's first gram). Letters are lowered, all else is a space;
    grams with two spaces in a row don't count."""
    n = len(data)
    if n < 4:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    b = _LOWER[data]
    upper = (b[1:] < 0x9F) & (b[1:] >= 0x80) & (b[1:] != 0x97) & (b[:-1] == 0xC3)
    b[1:][upper] += 0x20
    g = b[: n - 3].astype(np.uint32)
    for k in (1, 2, 3):
        g |= b[k : n - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    space = b == 32
    two = space[:-1] & space[1:]
    ok = ~(two[: n - 3] | two[1 : n - 2] | two[2:])
    for k in (1, 2, 3):  # grams that would reach over the end of a text
        bad = offsets[1:] - k
        bad = bad[(bad >= offsets[:-1]) & (bad < n - 3)]
        ok[bad] = False
    at = np.flatnonzero(ok)
    return g[at], np.searchsorted(at, offsets)


class Model:
    """The bit-sliced filter: a slot has a bit for each language, in words of WORD languages."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], slot_bits: int = SLOT_BITS, hashes: int = HASHES):
        self.langs, self.slot_bits, self.hashes = langs, slot_bits, hashes
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 62)) if len(langs) <= n)
        self.slots = [np.zeros(1 << slot_bits, kind) for _ in range(0, max(1, len(langs)), WORD)]
        self.false = np.zeros(len(langs))
        for k, own in enumerate(grams):
            slots, bit = self.slots[k // WORD], kind(1 << k % WORD)
            for at in self.places(np.asarray(own, np.uint32)):
                slots[at] |= bit
            full = np.count_nonzero(slots & bit) / len(slots)
            self.false[k] = full**hashes

    def places(self, g: np.ndarray) -> list[np.ndarray]:
        h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        keep = np.uint64((1 << self.slot_bits) - 1)
        return [(h >> np.uint64(64 - (k + 1) * self.slot_bits)) & keep for k in range(self.hashes)]

    def masks(self, g: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the set of the languages that contain it, of those in a word of WORD bits."""
        first, *rest = self.places(g)
        m = self.slots[word][first]
        for at in rest:
            m &= self.slots[word][at]
        return m

    def classify(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index or -1, corrected rate, n-grams) of each text."""
        data, offsets = buffers(texts)
        n = len(offsets) - 1
        best, rate, total = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
        for i, j in row_ranges(offsets):
            a = int(offsets[i])
            g, first = grams_of(data[a : int(offsets[j])], offsets[i : j + 1] - a)
            total[i:j] = np.diff(first)
            if not self.langs or not len(g):
                continue
            some = total[i:j] > 0
            at, count = first[:-1][some], total[i:j][some]
            rates = np.empty((len(self.langs), len(at)))
            for k in range(len(self.langs)):
                if k % WORD == 0:
                    masks = self.masks(g, k // WORD)
                hits = np.add.reduceat((masks >> masks.dtype.type(k % WORD)) & masks.dtype.type(1), at, dtype=np.int64)
                rates[k] = np.maximum(0, (hits / count - self.false[k]) / (1 - self.false[k]))
            top = rates.argmax(0)
            best[i:j][some], rate[i:j][some] = top, rates[top, np.arange(len(at))]
        best[rate <= 0] = -1
        return best, rate, total


def _gram_counts(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for b in batches:
        data, offsets = buffers(b.column("text"))
        codes = b.column("lang").dictionary_encode()
        code, names = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary.to_pylist()
        for i, j in row_ranges(offsets):
            a = int(offsets[i])
            g, first = grams_of(data[a : int(offsets[j])], offsets[i : j + 1] - a)
            both, n = np.unique((np.repeat(code[i:j], np.diff(first)) << 32) | g.astype(np.int64), return_counts=True)
            lang = pa.DictionaryArray.from_arrays(pa.array(both >> 32), pa.array(names, pa.string())).dictionary_decode() if len(both) else pa.array([], pa.string())
            yield batch(schema, lang, both & 0xFFFFFFFF, n)


def train(docs: DataFrame, per_lang: int = PER_LANG, grams: int = GRAMS, slot_bits: int = SLOT_BITS, hashes: int = HASHES) -> Model:
    """Fit the filters on a bounded sample of the labelled rows; the driver gets at most
    `grams` rows of each language."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = cut(ids.withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") <= per_lang).select(F.col("doc_id").alias("_id")).distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    sample = rows.join(maybe_broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").select("lang", "text")
    counts = sample.mapInArrow(tidy(_gram_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("_nth", F.row_number().over(most)).where(F.col("_nth") <= grams).select("lang", "gram").toPandas()
    langs = sorted(top["lang"].unique())
    return Model(langs, [top.loc[top["lang"] == x, "gram"].to_numpy() for x in langs], slot_bits, hashes)


def identify_udf(model: Model):
    """Column function text -> (lang, rate, n_grams); only the text goes to Python."""

    def identify(texts: pa.Array) -> pa.Array:
        best, rate, total = model.classify(texts)
        names = pa.array([*model.langs, "und"], pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(np.where(best < 0, len(model.langs), best))), pa.array(rate), pa.array(total)], fields=list(_RESULT))

    return F.arrow_udf(tidy_udf(identify), RESULT)


def identify(docs: DataFrame, model: Model | None = None, min_rate: float = MIN_RATE) -> DataFrame:
    """(doc_id, lang_id, rate, n_grams, keep) of each row of docs."""
    model = model or train(docs)
    got = text_of(docs).select("doc_id", identify_udf(model)("text").alias("r"))
    return got.select("doc_id", F.col("r.lang").alias("lang_id"), F.round("r.rate", 6).alias("rate"), F.col("r.n_grams").alias("n_grams"), ((F.col("r.rate") >= min_rate) & (F.col("r.lang") != "und")).alias("keep"))


def keep_identified(docs: DataFrame, model: Model | None = None, min_rate: float = MIN_RATE) -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told."""
    modest_batches(docs.sparkSession)
    got = identify_udf(model or train(docs))(F.col("text").cast("string"))
    return docs.where((got["rate"] >= min_rate) & (got["lang"] != "und"))

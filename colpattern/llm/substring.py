"""Exact substring duplicates across documents, found with difference-cover anchors.

A cover D modulo v has, for any two positions i and j, a shift d < v with i + d and j + d both
in D. So if two documents share at least `least` words, then whatever their alignment both
have an anchor (a position in D modulo v) at the same place within the first v words of the
shared passage, and the windows of `least - v + 1` words there are equal. Only these windows
are hashed and shuffled: |D| / v of the positions (6 of 31).

Windows that two documents share mark where to look. They are then extended: every window
of `least` words that covers such an anchor is hashed, and a window that occurs in two
documents is a repeat in each but the smallest doc_id's. Consecutive windows with the same
source are one span. All steps are linear in the words (no pairs are formed), so a passage
that thousands of documents share costs what its occurrences cost. A hash that a million rows have
(the text of a license) is salted by document, so its rows are spread over all tasks; the first rows of
the salts, which are few, then say what is the first of all. Whole copies are recognised by the hash
of their text before that, in an aggregate that combines before the shuffle.

Defined results: only repeats in *different* documents count; the copy in the document with
the smallest doc_id stays. Texts that are null, empty or shorter than `least` words have no
spans. Rows that share doc_id and text are one document; where rows share a doc_id but not the text,
the text that sorts first is searched. Other texts under an id, and rows with a null doc_id,
are left out of `spans` and stay as they are in `drop_repeats`. Windows are compared by
64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpattern.llm.common import batch, cut, fits_broadcast, fresh, hashed_words, maybe_broadcast, mix, modest_batches, one_row_per_id, signed, split_ids, spread, text_of, tidy, tidy_udf, window_hashes, word_bounds, word_count

#: Least words of a repeat.
LEAST = 50
#: A perfect difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

#: Rows of one hash beyond which they are spread over as many tasks as there are; found in the documents whose
#: id hash is divisible by HOT_SAMPLE, so by estimate, but that decides about the shuffle only.
HOT_ROWS, HOT_SAMPLE = 1_000_000, 64

_PLACE = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int32())])
_PLACE_DDL = "h long, salt int, doc_id long, pos int"
_HIT = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32())])
_DUP = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("src", pa.int64()), ("src_pos", pa.int32())])
_SPAN = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("src_doc_id", pa.int64()), ("src_start_word", pa.int64())])
SPANS = "doc_id long, start_word long, n_words long, src_doc_id long, src_start_word long"


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def anchors(n: np.ndarray, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of every cover position where a window of width words fits."""
    fit = np.maximum(0, n - width + 1)
    per = fit // period * len(cover) + np.searchsorted(np.asarray(cover), fit % period)
    row, k = np.repeat(np.arange(len(n)), per), spread(per)
    return row, k // len(cover) * period + np.asarray(cover)[k % len(cover)]


class Hot:
    """Hashes that too many rows have, and the salt (from 1 on) of their rows by document; 0 for others."""

    def __init__(self, hashes: np.ndarray, salts: int):
        self.hashes, self.salts = np.sort(hashes), salts

    def salt(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        if len(self.hashes):
            at = np.isin(h, self.hashes)
            out[at] = 1 + mix(doc[at].astype(np.uint64)) % np.uint64(self.salts)
        return out


_COLD = Hot(np.zeros(0, np.int64), 1)


def _hot(rows: DataFrame) -> Hot:
    """The hot hashes of rows (h, doc_id), which are those of the documents in the sample. A hash that stands in
    one document only is not hot: its rows are that document's."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where((F.col("n") >= HOT_ROWS / HOT_SAMPLE) & (F.col("lo") < F.col("hi")))
    return Hot(found.select("h").toPandas()["h"].to_numpy(np.int64), n)  # few: each has HOT_ROWS rows


def _sampled(docs: DataFrame) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)


def _anchors(width: int, period: int, cover: tuple[int, ...], hot: Hot = _COLD):
    cover = tuple(sorted(cover))

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, words, first in hashed_words(b.column("text")):
                row, pos = anchors(np.diff(first), width, period, cover)
                h, doc = signed(window_hashes(words, first[row] + pos, width)), ids[i:j][row]
                yield batch(_PLACE, h, hot.salt(h, doc), doc, pos.astype(np.int32))

    return run


def _first_of_group(*keys: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _shared(batches):
    """Of rows sorted by (h, salt, doc_id): those whose h occurs in two documents or more, as hot ones do. Only
    rows of one document are ever held back, until another document with the same h comes or h changes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None  # (h, first document) of the group that the last batch ended in
    for b in batches:
        if not b.num_rows:
            continue
        h, salt, doc, pos = (b.column(k).to_numpy() for k in range(4))
        at = _first_of_group(h)
        first, last = doc[at], doc[len(h) - 1 - _first_of_group(h[::-1])[::-1]]
        over = now is not None and now[0] == h[0]
        if over:
            first = np.where(at == 0, now[1], first)
        hit = (first != last) | (salt > 0)
        if over and hit[0]:
            for d, p in held:
                yield batch(_HIT, d, p)
        if not over or hit[0] or at[-1] != 0:
            held = []
        now = (h[-1], first[-1])
        if not hit[-1]:
            held.append((doc[at[-1] :], pos[at[-1] :]))
        yield batch(_HIT, doc[hit], pos[hit])


def _repeated(batches):
    """Of rows sorted by (h, salt, doc_id, pos): those not in the group's first document, with the first. Of hot
    hashes all rows, with the first of their salt."""
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        h, salt, doc, pos = (b.column(k).to_numpy() for k in range(4))
        at = _first_of_group(h, salt)
        first, place = doc[at], pos[at]
        if now is not None and now[:2] == (h[0], salt[0]):
            first, place = np.where(at == 0, now[2], first), np.where(at == 0, now[3], place).astype(np.int32)
        now = (h[-1], salt[-1], first[-1], place[-1])
        hit = (first != doc) | (salt > 0)
        yield batch(_DUP, h[hit], salt[hit] > 0, doc[hit], pos[hit], first[hit], place[hit])


def _windows(least: int, width: int, hot: Hot = _COLD):
    """Windows of least words that cover one of a document's marked anchors."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            marks = b.column("marks")
            flat, ends = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for i, j, words, first in hashed_words(b.column("text")):
                lo = ends[i - 1] if i else 0
                row = np.repeat(np.arange(j - i), np.diff(ends[i:j], prepend=lo))
                at = flat[lo : ends[j - 1]]
                n = np.diff(first)[row]
                a, z = np.maximum(0, at + width - least), np.minimum(at, n - least)
                ok = z >= a
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, first[row[ok]] + a[ok], 1)
                np.add.at(delta, first[row[ok]] + z[ok] + 1, -1)
                p = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
                r = np.searchsorted(first, p, "right") - 1
                h, doc = signed(window_hashes(words, p, least)), ids[i:j][r]
                yield batch(_PLACE, h, hot.salt(h, doc), doc, (p - first[r]).astype(np.int32))

    return run


def _spans(least: int):
    """Of windows sorted by (doc_id, pos): maximal runs with the same source and alignment."""

    def run(batches):
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            doc, pos, src, at = (b.column(k).to_numpy().astype(np.int64) for k in range(4))
            if tail is not None:
                doc, pos, src, at = (np.concatenate([[t], x]) for t, x in zip((tail[0], tail[1], tail[3], tail[4]), (doc, pos, src, at), strict=True))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (pos[1:] != pos[:-1] + 1) | (at[1:] != at[:-1] + 1)])
            start = np.flatnonzero(new)
            end = np.concatenate([start[1:], [len(doc)]]) - 1
            rows = [doc[start], pos[start], pos[end] - pos[start] + least, src[start], at[start]]
            if tail is not None and tail[5] is not None:  # the run that came over from the last batch
                rows[1][0], rows[4][0] = tail[5]
                rows[2][0] = pos[end[0]] - tail[5][0] + least
            begun = (int(rows[1][-1]), int(rows[4][-1]))
            tail = (int(doc[-1]), int(pos[-1]), None, int(src[-1]), int(at[-1]), begun)
            yield batch(_SPAN, *(x[:-1] for x in rows))
        if tail is not None:
            doc, pos, _, src, _, (start, at) = tail
            yield batch(_SPAN, [doc], [start], [pos - start + least], [src], [at])

    return run


def _by_key(df: DataFrame, keys: int, *sort: str) -> DataFrame:
    """df shuffled by the first `keys` of the columns it is then sorted by."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *sort[:keys]).sortWithinPartitions(*sort)


def spans(docs: DataFrame, least: int = LEAST, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(doc_id, start_word, n_words, src_doc_id, src_start_word): the words [start_word, start_word +
    n_words) of doc_id stand in src_doc_id, which is smaller, from src_start_word on."""
    if not is_cover(period, cover) or least < period:
        raise ValueError("cover must be a difference cover modulo period, and least at least period")
    width = least - period + 1
    own = one_row_per_id(text_of(docs))
    sums = own.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), F.length("text").alias("n"))
    same = ["h1", "h2", "n"]
    several = sums.groupBy(*same).agg(F.min("doc_id").alias("src"), F.count("*").alias("c")).where("c > 1").select(*[F.col(c).alias(f"_{c}") for c in same], "src")
    copied = cut(sums.join(maybe_broadcast(cut(several)), [F.col(c) == F.col(f"_{c}") for c in same]).where("src <> doc_id").select(F.col("doc_id").alias("id"), "src"))
    whole = cut(own.join(maybe_broadcast(copied), F.col("doc_id") == F.col("id")).select("doc_id", word_count().alias("n"), "src").where(F.col("n") >= least))
    copies = whole.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("n_words"), F.col("src").alias("src_doc_id"), F.lit(0).cast("long").alias("src_start_word"))
    rest = own.join(maybe_broadcast(whole.select(F.col("doc_id").alias("id"))), F.col("doc_id") == F.col("id"), "left_anti")
    seen = _sampled(rest).mapInArrow(tidy(_anchors(width, period, cover)), _PLACE_DDL)
    places = rest.mapInArrow(tidy(_anchors(width, period, cover, _hot(seen))), _PLACE_DDL)
    hits = _by_key(places, 2, "h", "salt", "doc_id").mapInArrow(tidy(_shared), "doc_id long, pos int")
    marks = cut(hits.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("pos").alias("marks")))
    ids = marks.select(F.col("id").alias("only"))
    some = rest.join(F.broadcast(ids), F.col("doc_id") == F.col("only"), "left_semi") if fits_broadcast(ids) else rest
    near = some.join(marks, F.col("doc_id") == F.col("id")).select("doc_id", "text", "marks")
    hot = _hot(_sampled(near).mapInArrow(tidy(_windows(least, width)), _PLACE_DDL))
    windows = near.mapInArrow(tidy(_windows(least, width, hot)), _PLACE_DDL)
    dups = _by_key(windows, 2, "h", "salt", "doc_id", "pos").mapInArrow(tidy(_repeated), "h long, hot boolean, doc_id long, pos int, src long, src_pos int")
    if len(hot.hashes):  # the first of each salt are few; the first of them is the source
        dups = cut(dups)
        sources = dups.where("hot").select("h", "src", "src_pos").distinct().groupBy(F.col("h").alias("k")).agg(F.min("src").alias("lo"), F.min_by("src_pos", "src").alias("lo_pos"))
        joined = dups.where("hot").join(maybe_broadcast(cut(sources)), F.col("h") == F.col("k")).where("doc_id <> lo").select("doc_id", "pos", F.col("lo").alias("src"), F.col("lo_pos").alias("src_pos"))
        dups = dups.where("not hot").select("doc_id", "pos", "src", "src_pos").unionByName(joined)
    else:
        dups = dups.select("doc_id", "pos", "src", "src_pos")
    return _by_key(dups, 1, "doc_id", "pos").mapInArrow(tidy(_spans(least)), SPANS).unionByName(copies)


def cut_words(text: str, starts: list[int], lengths: list[int]) -> str:
    """text without the given ranges of words; the white space after a removed word goes too."""
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end = word_bounds(data, np.array([0, len(data)]))
    edge = np.append(begin, len(data))
    keep = np.ones(len(data), bool)
    for s, n in zip(starts, lengths, strict=True):
        keep[edge[min(s, len(begin))] : edge[min(s + n, len(begin))]] = False
    return data[keep].tobytes().decode().rstrip()


def _cut(text: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    rows = zip(text.to_pylist(), starts.to_pylist(), lengths.to_pylist(), strict=True)
    return pa.array([None if t is None or a is None else cut_words(t, a, n) for t, a, n in rows], pa.string())


def drop_repeats(docs: DataFrame, **params) -> DataFrame:
    """docs without the repeated spans (the first copy stays), n_chars renewed where it exists.
    A document of which nothing is left goes; all others keep their rows and columns."""
    modest_batches(docs.sparkSession)
    s, n, key = (fresh(docs, x) for x in ("_starts", "_lengths", "_key"))
    found = spans(docs, **params).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("start_word").alias(s), F.collect_list("n_words").alias(n))
    found = cut(found)
    known, others = split_ids(docs)
    joined = known.join(maybe_broadcast(found), F.col("doc_id") == F.col(key), "left")
    hit = F.col(s).isNotNull()
    left = F.arrow_udf(tidy_udf(_cut), "string")(F.when(hit, F.col("text")), s, n)
    new = fresh(docs, "_left")
    out = joined.withColumn(new, left).where(~hit | (F.length(new) > 0))
    columns = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(hit, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    out = out.withColumns(columns).select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))
    return out if others is None else out.unionByName(others)

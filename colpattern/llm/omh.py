"""Near-duplicate groups with Order MinHash, verified by banded alignment.

Sketch: each of `sketches` hash functions picks the `picks` smallest occurrence-labelled word
k-mers of a document and keeps them in text order, so two documents agree on a sketch when
they share k-mers *in the same order* (sensitive to edit similarity, not only to the set). 40
sketches of 2 ordered 3-word k-mers find nine of ten pairs or more whose similarity is just `least`
and whose edits are scattered. Short texts (up to 14 words at 0.8) have too few k-mers for that;
their keys are all the ways to lose as many words as edits are allowed, so that no close pair of
them is missed. Documents that agree on a sketch or on such a key form a bucket. First everyone is compared with one leader (of
the smallest doc_ids of its buckets the one it meets most often). Clusters of a bucket that are
still apart are then compared by their 1, 8, 64, ... smallest members, clusters being joined
after each round, until every pair of a bucket is in one cluster or was compared (all at once
where that is few pairs); a test on lengths and word parities that needs no text and drops no
true pair goes before (`parity`). So the groups are those that comparing all pairs of all
buckets would give. A comparison is a banded alignment over words (the band is as
wide as the allowed number of edits): similarity = 1 - edits / longer length >= `least`.
Verified pairs are edges; the groups are the connected components.

Scale: no texts move except those of documents that share a bucket; exact copies are collapsed
first; buckets and clusters are summed up by aggregates that combine before the shuffle, and a
bucket's leader is compared in salted slices, so a group of a million copies is not one task's work.
What is broadcast is checked for its rows first; beyond that the same join shuffles.

Defined results: texts without words (null, empty, white space) are no one's copies and form
groups of their own; texts that differ only in white space are exact copies; of rows that
share doc_id and text, one stays; where rows share a doc_id but not the text, the text that sorts
first stands for the id and the others are not compared. Nor are rows with a null doc_id. `groups`
leaves both out and `drop_near_duplicates` keeps them. An empty table gives an empty result. The kept document of a group is that with the smallest doc_id.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.llm.common import batch, cut, fresh, hashed_words, maybe_broadcast, mix, modest_batches, one_row_per_id, signed, split_ids, spread, text_of, tidy

#: Words of a k-mer, k-mers of a sketch, sketches of a document.
K, PICKS, SKETCHES = 3, 2, 40
#: Least similarity of two documents that count as copies.
LEAST = 0.8
#: Most keys of a short text, whose ways to lose the allowed number of words are all listed.
SHORT_KEYS = 128
#: Members that a task compares with a leader before another slice begins.
SLICE = 512
#: Factor of the members that stand for a cluster from round to round; pairs across the clusters
#: of buckets, for each row in a bucket, up to which all are compared in one round.
GROWTH, PAIRS_A_ROW = 8, 4

_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()), *((f"b{k}", pa.int64()) for k in range(4)), ("keys", pa.list_(pa.int64()))])
_SKETCH_DDL = "doc_id long, h1 long, h2 long, n_words long, b0 long, b1 long, b2 long, b3 long, keys array<long>"


def kmers(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer hashes, each text's first k-mer); a text of fewer than k words is one k-mer."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1], count) + spread(count)
    width = np.minimum(np.repeat(n, count), k)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        part = padded[at + i]
        if i:
            part[width <= i] = 0
        h = (h + part) * _U(0x9E3779B97F4A7C15) ^ (h >> _U(29))
    return mix(h), start


def occurrences(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many times each value has come before in its row."""
    if not len(h):
        return np.zeros(0, np.int64)
    bits = max(1, int(row[-1]).bit_length())
    key = (row.astype(np.uint64) << _U(64 - bits)) | (h >> _U(bits))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketch(words: np.ndarray, first: np.ndarray, k: int = K, picks: int = PICKS, sketches: int = SKETCHES, seed: int = 1) -> np.ndarray:
    """[rows, sketches] bucket keys; rows without words get zeros."""
    g, start = kmers(words, first, k)
    count = np.diff(start)
    out = np.zeros((len(count), sketches), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    lo, count = start[:-1][some], count[some]
    local = spread(count).astype(np.uint64)
    occ = occurrences(g, np.repeat(np.arange(len(some)), count))
    labelled = mix(g + occ.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    bits = _U(max(1, int(count.max() - 1).bit_length()))
    high = _MAX << bits
    rng = np.random.default_rng(seed)
    for j in range(sketches):
        xor, mul, salt = rng.integers(0, 2**63, 3, dtype=np.uint64)
        v = (((labelled ^ xor) * (mul * _U(2) + _U(1))) & high) | local
        places = np.full((len(some), picks), np.iinfo(np.int64).max)
        for p in range(picks):
            at = (np.minimum.reduceat(v, lo) & ~high).astype(np.int64)
            has = count > p
            places[has, p] = at[has]
            v[lo[has] + at[has]] = _MAX
        places.sort(axis=1)
        key = np.full(len(some), salt)
        for p in range(picks):
            has = count > p
            part = np.zeros(len(some), np.uint64)
            part[has] = g[lo[has] + places[has, p]]
            key = mix(key * _U(0x9E3779B97F4A7C15) + part)
        out[some, j] = key
    return out


def short_words(least: float, most: int = SHORT_KEYS) -> int:
    """The most words of a text for which all ways to lose the edits allowed at `least` are at most `most`."""
    n = 0
    while n < most and sum(comb(n + 1, d) for d in range(allowed(n + 1, n + 1, least) + 1)) <= most:
        n += 1
    return n


def shortened(words: np.ndarray, first: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of n words, [rows, ways] keys): a key for each way to leave out at most the allowed words.
    Two texts whose edits are allowed become equal when each loses at most the words its own length allows."""
    rows = np.flatnonzero(np.diff(first) == n)
    own = words[first[rows][:, None] + np.arange(n)]
    keys = []
    for d in range(min(allowed(n, n, least), n - 1) + 1):
        for left in combinations(range(n), n - d):
            h = np.full(len(rows), n - d, np.uint64)
            for c in left:
                h = mix(h * _U(0x9E3779B97F4A7C15) + own[:, c])
            keys.append(h)
    return rows, np.stack(keys, 1)


def bucket_keys(words: np.ndarray, first: np.ndarray, k: int = K, picks: int = PICKS, sketches: int = SKETCHES, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(keys, each text's first key). Texts that are short enough have the keys of `shortened`: any close
    pair of them shares one. Texts that can be close to a longer one have sketches; both kinds overlap."""
    n = np.diff(first)
    short = short_words(least)
    sketched = np.flatnonzero(n >= max(1, short + 1 - allowed(short + 1, short + 1, least)))
    row, key = [np.repeat(sketched, sketches)], [np.zeros(0, np.uint64)]
    if len(sketched):
        pick = np.concatenate([[0], np.cumsum(n[sketched])])
        key.append(sketch(words[np.repeat(first[sketched], n[sketched]) + spread(n[sketched])], pick, k, picks, sketches).ravel())
    for m in np.unique(n[(n > 0) & (n <= short)]):
        at, own = shortened(words, first, int(m), least)
        own.sort(axis=1)
        new = np.concatenate([np.ones((len(at), 1), bool), own[:, 1:] != own[:, :-1]], 1)
        row.append(np.repeat(at, new.sum(1)))
        key.append(own[new])
    row, key = np.concatenate(row), np.concatenate(key)
    return key[np.argsort(row, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])


def parity(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[4, rows]: 256 bits of each text, a bit being the parity of the words that hash to it. An edit
    flips at most two, so texts whose bits differ in more than 2 * most places are further than
    `most` edits apart: a test without texts that never drops a true pair."""
    out = np.zeros((4, len(first) - 1), np.uint64)
    some = np.diff(first) > 0
    if some.any():
        bit, part = _U(1) << (words & _U(63)), (words >> _U(6)) & _U(3)
        for k in range(4):
            out[k][some] = np.bitwise_xor.reduceat(np.where(part == _U(k), bit, _U(0)), first[:-1][some])
    return out


def _sketches(k: int, picks: int, sketches: int, least: float):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, words, first in hashed_words(b.column("text")):
                n = np.diff(first)
                some = n > 0
                h = np.zeros((2, j - i), np.uint64)
                if some.any():
                    at = spread(n).astype(np.uint64)
                    for t, c in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                        h[t][some] = np.add.reduceat(mix(words + mix(at * _U(c) + _U(t + 1))), first[:-1][some])
                keys, start = bucket_keys(words, first, k, picks, sketches, least)
                flat = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(signed(keys)))
                yield batch(_SKETCH, ids[i:j], signed(h[0]), signed(h[1]), n, *map(signed, parity(words, first)), flat)

    return run


# ------------------------------------------------ alignment
def positions(words: list[int]) -> dict[int, int]:
    """For each word the bit set of the places where it stands."""
    out: dict[int, int] = {}
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    for w, places in at.items():
        if len(places) == 1:
            out[w] = 1 << places[0]
        else:
            bits = bytearray((places[-1] >> 3) + 1)
            for i in places:
                bits[i >> 3] |= 1 << (i & 7)
            out[w] = int.from_bytes(bits, "little")
    return out


def banded_distance(where: dict[int, int], n: int, other: list[int], most: int) -> int:
    """Edits between a text (positions() of its n words) and other, or most + 1 if it takes more.

    Bit-parallel over the band of 2 * most + 2 diagonals: one column is a few operations on
    integers as wide as the band.
    """
    m = len(other)
    if abs(n - m) > most:
        return most + 1
    if n <= most:  # the band covers everything; keep it inside the text
        most_, cap = n - 1, most
        if most_ < 0:
            return m if m <= most else most + 1
        return _plain(where, n, other, cap)
    width = 2 * most + 2
    full = (1 << width) - 1
    top, row = 1 << (width - 1), 1 << (width - 2)
    vp, vn = full & ~((1 << (width - most - 1)) - 1), 0
    score, limit = most, 2 * most + m - n
    start = most + 1 - width
    turn = n - most
    get = where.get
    for i, c in enumerate(other):
        x = get(c, 0)
        if x:
            x = (x >> start if start >= 0 else x << -start) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if i < turn:
            if not d0 & top:
                score += 1
        else:
            if hp & row:
                score += 1
            elif hn & row:
                score -= 1
            row >>= 1
        if score > limit:
            return most + 1
        d0 >>= 1
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
        start += 1
    return score if score <= most else most + 1


def _plain(where: dict[int, int], n: int, other: list[int], most: int) -> int:
    """The same without a band, for texts that are shorter than the band."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score = full, 0, n
    for c in other:
        x = where.get(c, 0)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
    return score if score <= most else most + 1


def allowed(n: int, m: int, least: float) -> int:
    """Edits at which two texts of n and m words are still similar enough."""
    return int((1 - least) * max(n, m) + 1e-9)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _compare(least: float):
    """Rows sorted by (leader, salt), the leader's own first; yields the pairs that are close."""

    def run(batches):
        now, where, n = None, {}, 0
        for b in batches:
            lead, salt, ids = (b.column(x).to_pylist() for x in ("a", "salt", "doc_id"))
            found = []
            for i, j, words, first in hashed_words(b.column("text")):
                for r in range(i, j):
                    w = words[first[r - i] : first[r - i + 1]].tolist()
                    if ids[r] == lead[r]:
                        now, n, where = (lead[r], salt[r]), len(w), positions(w)
                    elif now == (lead[r], salt[r]):
                        most = allowed(n, len(w), least)
                        d = banded_distance(where, n, w, most)
                        if d <= most:
                            found.append((lead[r], ids[r], 1 - d / max(n, len(w))))
            yield batch(_PAIR, *([x[c] for x in found] for c in range(3)))

    return run


def verify(docs: DataFrame, edges: DataFrame, least: float = LEAST, slice_rows: int = SLICE) -> DataFrame:
    """(a, b, similarity) of the edges (a, b) whose documents align well enough. docs: one row per doc_id."""
    per = edges.groupBy("a").agg(F.ceil(F.count("*") / slice_rows).alias("slices"))
    sliced = edges.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), "slices").alias("salt"))
    need = sliced.select("a", "salt", F.col("b").alias("id")).unionByName(sliced.select("a", "salt", F.col("a").alias("id")).distinct())
    rows = text_of(docs).join(maybe_broadcast(cut(need)), F.col("doc_id") == F.col("id")).select("a", "salt", "doc_id", "text")
    spark = docs.sparkSession
    ready = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "salt").sortWithinPartitions("a", "salt", F.col("doc_id") != F.col("a"), "doc_id")
    return ready.mapInArrow(tidy(_compare(least)), "a long, b long, similarity double")


# ------------------------------------------------ components
def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, root) for each end of the edges (a, b): root is the smallest id of its component.

    Alternates large-star and small-star steps until nothing changes (an error if that takes more
    than `rounds`); each round is a shuffle of the edges by one end, cut off from its lineage.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        was, state = state, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def plausible(a: str, b: str, least: float) -> Column:
    """Whether the structs a and b (n_words, b0..b3) leave room for a similarity of `least`."""
    n, m = F.col(f"{a}.n_words"), F.col(f"{b}.n_words")
    most = F.floor((1 - least) * F.greatest(n, m) + 1e-9)
    differ = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(1, 4)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    return (F.abs(n - m) <= most) & (differ <= 2 * most)


def _apart(near: DataFrame, root: DataFrame) -> tuple[DataFrame, int, int]:
    """(key, doc_id, root, big) of near (key, doc_id) in the buckets that hold more than one cluster, big
    being the largest cluster there; the pairs across clusters; the rows of the largest cluster."""
    names = maybe_broadcast(root.select(F.col("id").alias("rid"), F.col("root").alias("now")))
    here = near.select("key", "doc_id").join(names, F.col("doc_id") == F.col("rid"), "left").select("key", "doc_id", F.coalesce("now", "doc_id").alias("root"))
    sizes = here.groupBy("key", "root").agg(F.count("*").alias("c"))  # combined before the shuffle, as a bucket may be hot
    many = sizes.groupBy("key").agg(F.count("*").alias("clusters"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"), F.max(F.struct("c", "root")).alias("big")).where("clusters > 1")
    many = cut(many.select(F.col("key").alias("k"), "n", "within", F.col("big.c").alias("c"), F.col("big.root").alias("big")))
    crossing, largest = many.agg(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2), F.max("c")).first()
    rows = here.join(maybe_broadcast(many.select("k", "big")), F.col("key") == F.col("k")).select("key", "doc_id", "root", "big")
    return cut(rows), int(crossing or 0), int(largest or 0)


def _crossing(near: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """(a, b): the plausible pairs of each bucket whose ends are in different clusters. The members of
    the largest cluster are met only by those outside it, never by each other."""
    rows = cut(near.join(marks, F.col("doc_id") == F.col("r")).select("key", "root", "big", "doc_id", "x"))
    left, right = (rows.select("key", F.col("root").alias(f"r{s}"), F.col("big").alias(f"g{s}"), F.col("doc_id").alias(f"d{s}"), F.col("x").alias(f"x{s}")) for s in "lr")
    met = left.where("rl <> gl").join(right, "key").where("rl <> rr and (rr = gr or dl < dr)")
    return met.where(plausible("xl", "xr", least)).select(F.least("dl", "dr").alias("a"), F.greatest("dl", "dr").alias("b")).distinct()


def _joined(root: DataFrame, edges: DataFrame) -> DataFrame:
    """root (id, root) with the clusters that the edges (a, b) connect made one."""
    if edges.isEmpty():
        return root
    ends = [root.select(F.col("id").alias(f"id{x}"), F.col("root").alias(f"root{x}")) for x in "ab"]
    over = edges.join(ends[0], F.col("a") == F.col("ida"), "left").join(ends[1], F.col("b") == F.col("idb"), "left")
    new = cut(components(over.select(F.coalesce("roota", "a").alias("a"), F.coalesce("rootb", "b").alias("b"))).withColumnsRenamed({"id": "old", "root": "new"}))
    kept = root.join(new, F.col("root") == F.col("old"), "left").select("id", F.coalesce("new", "root").alias("root"))
    return cut(kept.unionByName(new.join(root, F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("root"))))


def groups(docs: DataFrame, k: int = K, picks: int = PICKS, sketches: int = SKETCHES, least: float = LEAST) -> DataFrame:
    """(doc_id, group_id, n_words, keep) of each document; group_id is the smallest doc_id of its group."""
    own = one_row_per_id(text_of(docs))
    sk = cut(own.mapInArrow(tidy(_sketches(k, picks, sketches, least)), _SKETCH_DDL))
    same = ["h1", "h2", "n_words"]  # found by an aggregate, as a third of all rows may be one text
    copies = sk.where("n_words > 0").groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same], "first")
    sk = sk.join(maybe_broadcast(cut(copies)), [F.col(c) == F.col(f"_{c}") for c in same], "left").withColumn("rep", F.coalesce("first", "doc_id")).drop("first", *[f"_{c}" for c in same])
    rows = sk.where("doc_id = rep and n_words > 0").select("doc_id", F.explode("keys").alias("key"))
    ends = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select(F.col("key").alias("k"), "a")
    near = cut(rows.join(maybe_broadcast(cut(ends)), F.col("key") == F.col("k")).select("key", "doc_id", "a"))
    tried = near.where("doc_id <> a").groupBy("doc_id", "a").agg(F.count("*").alias("n")).groupBy(F.col("doc_id").alias("b")).agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    marks = sk.select(F.col("doc_id").alias("r"), F.struct("n_words", "b0", "b1", "b2", "b3").alias("x"))
    tried = tried.join(marks.withColumnsRenamed({"r": "a", "x": "xa"}), "a").join(marks.withColumnsRenamed({"r": "b", "x": "xb"}), "b")
    tried = cut(tried.where(plausible("xa", "xb", least)).select("a", "b"))
    first = cut(verify(own, tried, least))
    root = components(first)
    grow, few = 1, PAIRS_A_ROW * near.count()
    while True:
        near, crossing, largest = _apart(near, root)
        if not crossing:
            break
        most = largest if crossing <= few else min(grow, largest)
        some = near
        if most < largest:  # each task keeps `most` rows of a cluster before the shuffle
            some = near.withColumn("nth", F.row_number().over(Window.partitionBy("key", "root").orderBy("doc_id"))).where(F.col("nth") <= most).drop("nth")
        pairs = cut(_crossing(some, marks, least).join(tried, ["a", "b"], "left_anti"))
        root = _joined(root, cut(verify(own, pairs, least).select("a", "b")))
        if most == largest:
            break
        tried, grow = cut(tried.unionByName(pairs)), grow * GROWTH
    got = sk.select("doc_id", "rep", "n_words").join(root, F.col("rep") == F.col("id"), "left")
    got = got.select("doc_id", F.coalesce("root", "rep").alias("group_id"), "n_words")
    return got.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """docs with one document of each group, all columns kept; rows with a null doc_id and further
    texts under an id stay."""
    modest_batches(docs.sparkSession)
    gone = fresh(docs, "_gone")
    drop = cut(groups(docs, **params).where("not keep").select(F.col("doc_id").alias(gone)))
    one, others = split_ids(docs)
    one = one.join(maybe_broadcast(drop), F.col("doc_id") == F.col(gone), "left_anti").unionByName(docs.where(F.col("doc_id").isNull()))
    return one if others is None else one.unionByName(others)

"""Packing of token sequences by patterns whose repeat counts a non-negative least squares fits.

Documents are cut into pieces of at most `max_len` tokens (all but the last are full), lengths
are rounded up to `step`, and the pieces of each length are counted. A pattern is a multiset of
at most `parts` lengths that fill a pack exactly. Repeat counts x >= 0 minimise the squared
distance of the patterns' lengths from the histogram; they are rounded, held within what there
is, and the pieces left over are packed best-fit, decreasing, on their histogram. The patterns
then account for every piece exactly, and a piece finds its pack from its length and its rank
among pieces of that length alone.

Scale: the driver sees the histogram (max_len / step rows) and the patterns, neither of which
grows with the corpus; ranks are two-level (a count per length and slice, then a window
within a slice). Packs that follow an order rank the slots in the same way. Only (doc_id, piece, length) is shuffled, no text.

Defined results: a null or empty text is one piece of the end mark alone; rows that share a
doc_id are packed as often as they stand, rows with a null doc_id too; ties in length are
ranked by (doc_id, piece), or by the order that is given; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.llm.common import cut, maybe_broadcast, modest_batches
from colpattern.llm.tokens import TOKENIZER, count_udf

#: Tokens of a pack, rounding of lengths, most documents of an enumerated pattern.
MAX_LEN, STEP, PARTS = 2048, 32, 3
#: Pieces of one length that one window ranks.
SLICE = 200_000


def patterns(size: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All multisets of at most `parts` lengths 1..size that add up to size, each in descending order."""
    out: list[tuple[int, ...]] = []

    def grow(now: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(now)
        elif len(now) < parts:
            for n in range(min(left, now[-1] if now else left), 0, -1):
                if n * (parts - len(now)) >= left:
                    grow((*now, n), left - n)

    grow((), size)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """x >= 0 with the least |a x - b| (Lawson and Hanson's active set method)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, rhs = a.T @ a, a.T @ b
    w = rhs.copy()
    scale = tolerance * max(1.0, np.abs(rhs).max(initial=0))
    for _ in range(3 * n):
        if passive.all() or w[~passive].max() <= scale:
            break
        passive[np.argmax(np.where(passive, -np.inf, w))] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            low = at[s <= 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = x[low] / (x[low] - s[s <= 0])
            x[at] += np.nanmin(np.where(np.isfinite(ratio), ratio, 0)) * (s - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
        w = rhs - gram @ x
    return x


def best_fit(hist: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram of lengths: (pattern, count) of the packs. Packs that
    are alike are handled together, so the work follows the lengths and not the pieces."""
    open_: dict[tuple[int, ...], int] = {}
    spaces: list[tuple[int, tuple[int, ...]]] = []

    def add(p: tuple[int, ...], m: int) -> None:
        if p not in open_:
            open_[p] = 0
            bisect.insort(spaces, (size - sum(p), p))
        open_[p] += m

    for n in sorted(hist, reverse=True):
        c = hist[n]
        while c:
            k = bisect.bisect_left(spaces, (n, ()))
            if k < len(spaces):
                space, p = spaces[k]
                m = min(c, open_[p])
                open_[p] -= m
                if not open_[p]:
                    del open_[p], spaces[k]
                add((*p, n), m)
                c -= m
            else:
                add((n,), c)
                each = size // n
                if each > 1 and c > 1:  # new packs take as many of this length as fit
                    open_[(n,)] -= c
                    if not open_[(n,)]:
                        del open_[(n,)]
                        spaces.remove((size - n, (n,)))
                    full, rest = divmod(c, each)
                    if full:
                        add((n,) * each, full)
                    if rest:
                        add((n,) * rest, 1)
                c = 0
    return [(p, m) for p, m in open_.items() if m]


def plan(hist: dict[int, int], size: int, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeat count) pairs that use up the histogram {length: pieces} exactly."""
    if not hist:
        return []
    all_ = patterns(size, parts)
    a = np.zeros((size, len(all_)))
    for k, p in enumerate(all_):
        for n in p:
            a[n - 1, k] += 1
    h = np.array([hist.get(n, 0) for n in range(1, size + 1)], float)
    x = nnls(a, h)
    left, out = Counter(hist), []
    for k in np.argsort(-x, kind="stable"):
        need = Counter(all_[k])
        r = min(int(np.rint(x[k])), *(left[n] // m for n, m in need.items()))
        if r > 0:
            out.append((all_[k], r))
            for n, m in need.items():
                left[n] -= m * r
    rest = best_fit({n: c for n, c in left.items() if c}, size)
    merged: Counter = Counter()
    for p, r in [*out, *rest]:
        merged[tuple(sorted(p, reverse=True))] += r
    return sorted(merged.items(), key=lambda x: (-x[1], x[0]))


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first pack, slots of this length a pack, first slot)."""
    out, used, pack = [], Counter(), 0
    for p, r in plan_:
        for n, m in Counter(p).items():
            out.append((n, used[n], used[n] + m * r, pack, m, p.index(n)))
            used[n] += m * r
        pack += r
    return out


def stored_order(docs: DataFrame) -> tuple[Column, Column]:
    """(major, minor): the order in which rows stand in the files of docs, or in docs where it has none."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.lpad(F.spark_partition_id().cast("string"), 10, "0"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_name"), F.col("_metadata.row_index")


def pieces(docs: DataFrame, tokens: Column, max_len: int, *more: Column) -> DataFrame:
    """(doc_id, piece, n): documents cut to at most max_len tokens, an end mark counted in; more
    columns of the documents stand at the end."""
    names = [f"o{k}" for k in range(len(more))]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (tokens + 1).cast("long").alias("total"), *[c.alias(x) for c, x in zip(more, names, strict=True)])
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / max_len))))
    return own.select("doc_id", "piece", F.least(F.col("total") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("n"), *names)


def numbered(df: DataFrame, by: list[str], slices: list[str], order: list[str], name: str) -> DataFrame:
    """df with name: the row's number among the rows of `by`, in the order of (slices, order)."""
    keys = [*by, *slices]
    counts = df.groupBy(*keys).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*by).orderBy(*slices)) - F.col("c")
    offsets = cut(counts.select(*[F.col(x).alias(f"_{x}") for x in keys], before.alias("before")))
    same = [F.col(x) == F.col(f"_{x}") for x in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + F.col("before")
    return df.join(maybe_broadcast(offsets), same).withColumn(name, rank).drop("before", *[f"_{x}" for x in keys])


def in_turn(all_: DataFrame, plan_: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """(pack_id, slot, doc_id, piece, n_tokens): the pieces, which have an order (o0, o1), put into the
    plan's packs so that packs follow it. The k-th of a pattern's r packs is due at (k + 1/2) / r;
    slots of a length take its pieces in turn, and packs are numbered by their pieces' mean position."""
    spark = all_.sparkSession
    rows, first = [], 0
    for p, r in plan_:
        rows += [(first, k, min(k + SLICE, r), r, list(p)) for k in range(0, r, SLICE)]
        first += r
    packs = spark.createDataFrame(rows, "first long, lo long, hi long, r long, parts array<int>").repartition(max(1, min(len(rows), 64)))
    packs = packs.select("first", "r", "parts", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("k"))
    packs = packs.select((F.col("first") + F.col("k")).alias("pack"), ((F.col("k") + 0.5) / F.col("r")).alias("due"), F.posexplode("parts").alias("slot", "b"))
    packs = packs.withColumn("part", F.floor(F.col("due") * (1 + first // SLICE)))
    slots_ = numbered(packs, ["b"], ["part"], ["due", "pack", "slot"], "at")
    all_ = all_.withColumn("o2", F.floor(F.col("o1") / SLICE))
    slices = all_.groupBy("o0", "o2").agg(F.count("*").alias("c"))
    slices = cut(slices.select(F.col("o0").alias("_m"), F.col("o2").alias("_p"), (F.sum("c").over(Window.orderBy("o0", "o2")) - F.col("c")).alias("base")))  # a row for each slice
    all_ = all_.join(maybe_broadcast(slices), (F.col("o0") == F.col("_m")) & (F.col("o2") == F.col("_p"))).withColumn("position", F.col("base") + F.col("o1") % SLICE)
    ranked = numbered(all_, ["bin"], ["o0", "o2"], ["o1", "piece"], "rank")
    put = cut(ranked.join(slots_, (F.col("bin") == F.col("b")) & (F.col("rank") == F.col("at"))).select("pack", "slot", "doc_id", "piece", F.col("n").alias("n_tokens"), "position"))
    means = cut(put.groupBy("pack").agg(F.avg("position").alias("mean")).select("pack", "mean", F.floor(F.col("mean") / SLICE).alias("part"), F.lit(0).alias("all")))
    means = numbered(means, ["all"], ["part"], ["mean", "pack"], "pack_id").select(F.col("pack").alias("_pack"), "pack_id")
    return put.join(means, F.col("pack") == F.col("_pack")).select("pack_id", "slot", "doc_id", "piece", "n_tokens")


def by_id(all_: DataFrame, plan_: list[tuple[tuple[int, ...], int]], hist: dict[int, int]) -> DataFrame:
    """(pack_id, slot, doc_id, piece, n_tokens): the pieces put into the plan's packs by their ids."""
    table = all_.sparkSession.createDataFrame(slots(plan_), "b int, lo long, hi long, first long, each int, at int")
    salts = max(1, -(-max(hist.values(), default=0) // SLICE))
    ranked = all_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    if salts > 1:
        counts = ranked.groupBy("bin", "salt").agg(F.count("*").alias("c"))
        offsets = counts.select(F.col("bin").alias("ob"), F.col("salt").alias("os"), (F.sum("c").over(Window.partitionBy("bin").orderBy("salt")) - F.col("c")).alias("before"))
        ranked = ranked.join(maybe_broadcast(cut(offsets)), (F.col("bin") == F.col("ob")) & (F.col("salt") == F.col("os")))
    else:
        ranked = ranked.withColumn("before", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "piece")) - 1 + F.col("before")
    ranked = ranked.withColumn("rank", rank)
    put = ranked.join(F.broadcast(table), (F.col("bin") == F.col("b")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return put.select((F.col("first") + F.floor(k / F.col("each"))).alias("pack_id"), (F.col("at") + k % F.col("each")).cast("int").alias("slot"), "doc_id", "piece", F.col("n").alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, step: int = STEP, parts: int = PARTS, tokens: Column | None = None, tokenizer: str = TOKENIZER, order: tuple[Column, Column] | None = None) -> DataFrame:
    """(pack_id, slot, start, doc_id, piece, n_tokens): which piece of a document stands where.
    tokens: the length of a row, by default the ids of its text with the tokenizer. order: (major,
    minor) of each row, as `stored_order` has it, if packs are to follow it."""
    if max_len % step:
        raise ValueError("max_len must be a multiple of step")
    spark = docs.sparkSession
    modest_batches(spark)
    count = tokens if tokens is not None else count_udf(tokenizer)(F.col("text").cast("string"))
    all_ = cut(pieces(docs, count, max_len, *(order or ())))
    all_ = all_.withColumn("bin", F.ceil(F.col("n") / step).cast("int"))
    hist = {r["bin"]: r["count"] for r in all_.groupBy("bin").count().collect()}  # max_len / step rows
    size = max_len // step
    if order:
        put = in_turn(all_, plan(hist, size, parts))
    else:
        put = by_id(all_, plan(hist, size, parts), hist)
    before = F.sum("n_tokens").over(Window.partitionBy("pack_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return put.select("pack_id", "slot", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "doc_id", "piece", "n_tokens")

"""Time-varying mixture of sources: who is read when, so that each moment has its target weights.

Every source s has a weight schedule w_s(t) over training time t in [0, 1], piecewise linear
between the points of a grid and normalised over the sources at each of them. Until time t
the training asks source s for D_s(t) = T * integral of w_s over [0, t] tokens. Documents of a
source stand in hash order; the document that begins after c of its source's tokens is due when
the demand reaches c, so its position is the inverse of D_s at c (a quadratic on each segment,
solved in closed form). Sorting all documents by position by range is the training order.

T is `total_tokens`, or by default the least at which every document is used once: sources
that are asked for more than they have are read again from their beginning (`epoch` counts
that), none is cut. With a given T, documents beyond their source's demand are left out.

Scale: prefix sums are two-level. Hash order is cut into slices, (source, slice) sums are
added up on their small table, and only within a slice runs a window, so a source that holds
most of the corpus is as many tasks as it has slices. Only ids and counts are ranked; texts
join their positions by broadcast where these are few (checked), else by a shuffle on the id.

Defined results: a null source is a source of its own; a text that is null or has no words has
0 tokens and stands where the next one of its source does; rows that share a doc_id (or have
none) are all placed; a source of weight 0 is never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.llm.common import cut, fresh, maybe_broadcast, word_count

#: Grid of training time, and the power of a source's share of the tokens that is its weight
#: there, unless a schedule names it: from as it comes to flatter.
GRID = (0.0, 0.5, 1.0)
TEMPER = (1.0, 0.9, 0.7)
#: Documents of a source that one window sorts.
SLICE = 50_000


def _hash(c: Column) -> Column:
    return F.md5(F.coalesce(c.cast("string"), F.lit("")))


def inverse(area: Column, grid: Sequence[float], w: Column, cum: Column) -> Column:
    """The t at which the integral of a schedule reaches area: w are its weights at the grid's
    points, cum the integrals up to them."""
    out = F.lit(float(grid[-1]))
    for k in reversed(range(len(grid) - 1)):
        a, b, step = w[k], w[k + 1], grid[k + 1] - grid[k]
        rest = F.greatest(area - cum[k], F.lit(0.0))
        slope = (b - a) / step
        root = F.sqrt(F.greatest(a * a + 2 * slope * rest, F.lit(0.0)))
        x = F.when(rest > 0, 2 * rest / (a + root)).otherwise(0.0)
        out = F.when(area < cum[k + 1], grid[k] + F.least(x, F.lit(step))).otherwise(out)
    return out


def demand(sums: DataFrame, schedules: Mapping[str, Sequence[float]] | None, grid: Sequence[float], temper: Sequence[float], total_tokens: float | None) -> DataFrame:
    """(key, supply, w, cum, total) of each source. sums: (key, supply), one row per source."""
    total = sums.agg(F.sum("supply").alias("all"))
    share = F.when(F.col("all") > 0, F.col("supply") / F.col("all")).otherwise(F.lit(1.0))
    raw = [F.pow(share, F.lit(float(p))) for p in temper]
    for name, own in (schedules or {}).items():
        if len(own) != len(grid) or min(own) < 0:
            raise ValueError(f"the schedule of {name} needs {len(grid)} weights, none negative")
        raw = [F.when(F.col("key") == "s" + name, F.lit(float(v))).otherwise(r) for v, r in zip(own, raw, strict=True)]
    raw = [F.when((F.col("supply") > 0) | (F.col("all") == 0), r).otherwise(0.0) for r in raw]
    t = sums.crossJoin(F.broadcast(total)).withColumns({f"r{k}": r for k, r in enumerate(raw)})
    norm = t.agg(*[F.sum(f"r{k}").alias(f"z{k}") for k in range(len(grid))])
    w = [F.when(F.col(f"z{k}") > 0, F.col(f"r{k}") / F.col(f"z{k}")).otherwise(0.0) for k in range(len(grid))]
    t = t.crossJoin(F.broadcast(norm)).select("key", "supply", F.array(*w).alias("w"))
    cum = [F.lit(0.0)]
    for k in range(len(grid) - 1):
        cum.append(cum[-1] + (F.col("w")[k] + F.col("w")[k + 1]) * ((grid[k + 1] - grid[k]) / 2))
    t = t.withColumn("cum", F.array(*cum))
    share = F.element_at("cum", -1)
    least = t.agg((F.lit(float(total_tokens)) if total_tokens else F.coalesce(F.max(F.when(share > 0, F.col("supply") / share)), F.lit(0.0))).alias("total"))
    return t.crossJoin(F.broadcast(least))


def place(df: DataFrame, source: str, tokens: Column, ident: str = "doc_id", schedules: Mapping[str, Sequence[float]] | None = None, grid: Sequence[float] = GRID, temper: Sequence[float] = TEMPER, total_tokens: float | None = None, slice_rows: int = SLICE) -> DataFrame:
    """df with two more columns at its end: the epoch (bigint) and the position in [0, 1] (double). They are
    called _epoch and _t, with more underscores before where df has such columns."""
    n, h, key, part = (fresh(df, x) for x in ("_n_tok", "_h", "_skey", "_part"))
    base = df.withColumns({n: tokens.cast("double"), h: _hash(F.col(ident)), key: F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))})
    narrow = base.select(key, h, n)
    # the slices: finer where there are more rows, but always a cut of the same hash order
    fine = cut(narrow.groupBy(F.col(key).alias("key"), F.conv(F.substring(h, 1, 3), 16, 10).cast("int").alias("cell")).agg(F.sum(n).alias("s"), F.count("*").alias("c")))
    over = Window.partitionBy("key").orderBy("cell")
    fine = fine.withColumns({"before": F.sum("s").over(over) - F.col("s"), "slice": F.floor((F.sum("c").over(over) - F.col("c")) / slice_rows)})
    cells = fine.withColumn("start", F.min("before").over(Window.partitionBy("key", "slice"))).select("key", "cell", "slice", "start")
    sources = demand(fine.groupBy("key").agg(F.sum("s").alias("supply")), schedules, grid, temper, total_tokens)
    cells, sources = cut(cells), cut(sources)
    names = {c: fresh(df, f"_m_{c}") for c in ("key", "cell", "slice", "start", "src", "supply", "w", "cum", "total")}
    cells = cells.select(*[F.col(c).alias(names[c]) for c in ("key", "cell", "slice", "start")])
    sources = sources.select(F.col("key").alias(names["src"]), *[F.col(c).alias(names[c]) for c in ("supply", "w", "cum", "total")])
    base = base.withColumn(part, F.conv(F.substring(h, 1, 3), 16, 10).cast("int"))
    joined = base.join(maybe_broadcast(cells, 200_000), (F.col(key) == F.col(names["key"])) & (F.col(part) == F.col(names["cell"])))
    joined = joined.join(maybe_broadcast(sources, 200_000), F.col(key) == F.col(names["src"]))
    running = Window.partitionBy(key, names["slice"]).orderBy(h, F.col(ident)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col(names["start"]) + F.coalesce(F.sum(n).over(running), F.lit(0.0))
    c = fresh(df, "_before")
    joined = joined.withColumn(c, before)
    supply, total, w, cum = (F.col(names[x]) for x in ("supply", "total", "w", "cum"))
    asked = total * F.element_at(cum, -1)
    copies = F.when(supply > 0, F.ceil((asked - F.col(c)) / supply - 1e-9)).otherwise(F.lit(1)).cast("long")
    if total_tokens is None:
        copies = F.when(F.element_at(cum, -1) > 0, F.greatest(copies, F.lit(1))).otherwise(F.when(supply == 0, F.lit(1)).otherwise(0))
    k, e, t = (fresh(df, x) for x in ("_copies", "_epoch", "_t"))
    joined = joined.withColumn(k, copies).where(F.col(k) > 0).withColumn(e, F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)))
    area = F.when(total > 0, (F.col(c) + F.col(e) * supply) / total).otherwise(0.0)
    return joined.withColumn(t, inverse(area, grid, w, cum)).select(*[f"`{x}`" for x in df.columns], e, t)


def _range_sorted(df: DataFrame, *order: str) -> DataFrame:
    """df as ranges of `order`, each sorted: read one after the other, its partitions are in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def schedule(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, position) in training order: position is the document's place in
    [0, 1]. Rows are range-sorted by the position before it is rounded, which many may share after; ties
    follow doc_id, epoch, source and n_tokens, so that only equal rows are left tied."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("n_tokens"))
    got = _range_sorted(place(cut(own), "source", F.col("n_tokens"), **params), "_t", "doc_id", "_epoch", "source", "n_tokens")
    return got.select("doc_id", "source", F.col("_epoch").alias("epoch"), "n_tokens", F.round("_t", 6).alias("position"))


def in_order(docs: DataFrame, **params) -> DataFrame:
    """docs, all columns kept, range-sorted by position; a document stands once per epoch.

    Words are counted once, ids and counts alone are ranked, and the texts move only with their
    positions. Where ids are null or repeat they can't say whose position it is; then whole rows are ranked."""
    e, t, i = (fresh(docs, x) for x in ("_epoch", "_t", "_id"))
    own = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("n_tokens")))
    if own.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        placed = cut(place(own, "source", F.col("n_tokens"), **params).select(F.col("doc_id").alias(i), F.col("_epoch").alias(e), F.col("_t").alias(t)))
        out = docs.join(maybe_broadcast(placed), F.col("doc_id") == F.col(i)).drop(i)
    else:
        out = place(docs, "source", word_count(F.col("text").cast("string")), **params)
    return _range_sorted(out, t, "doc_id", e).drop(e, t)

"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors of d dimensions are projected to `m` by a Gaussian (2-stable) matrix: the squared
projected distance of two vectors is their squared distance times a chi-square variable with m
degrees of freedom. A query takes its neighbours in the projected space in ascending order from a
kd-tree (leaf by leaf), verifies their true distances, and stops as soon as the chi-square test
holds: projected distance**2 / d_k**2 > quantile_m(p), where d_k is the k-th best true distance so
far. A true neighbour then has been seen with probability p at least, so recall is at least p in
expectation (0.97 by default).

Distribution: equal vectors are one point, which stands for its k + 1 smallest ids (no other copy
can be among anyone's k nearest). The upper levels of the kd-tree split the points into cells of
about `cell_rows` (planes from a bounded sample; at most MAX_CELLS cells, so the tree of boxes that
every task gets is bounded). Each cell first answers the queries that lie in it; that bounds
d_k, and a descent of the tree of boxes names the cells within a query's stopping radius. There
the same search goes on with the bound found. The visitors of a cell are cut into slices of
`cell_rows`, each of which meets the cell's points in a task of its own. Every row that `ask` selects
(all by default) is a query against all rows; nothing is capped.

Defined results: vectors that are null, hold null or non-finite numbers, or whose length is not
the table's most frequent one (ties: the shortest) take no part, nor do rows with a null id; of
rows that share an id the smallest vector counts; equal vectors are neighbours at distance 0;
ties in distance go to the smaller id; with fewer than k others, all are listed. A null `ask` is no
query. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colpattern.llm.common import batch, cut, maybe_broadcast, tidy

#: Neighbours, dimensions of the projection, stopping probability, vectors of a cell, of a leaf.
NEIGHBOURS, M, P, CELL_ROWS, LEAF = 10, 8, 0.97, 2048, 64
#: Most cells; beyond it cells grow.
MAX_CELLS = 1 << 16
#: Classes of equal vectors that may be broadcast.
CLASSES = 100_000
#: Most vectors that place the cells' planes, per cell and at least.
SAMPLE_PER_CELL, SAMPLE = 32, 20_000

_POINT = pa.schema([("vec_id", pa.int64()), ("ask", pa.bool_()), ("vector", pa.binary()), ("low", pa.binary()), ("cell", pa.int32())])
_POINT_DDL = "vec_id long, ask boolean, vector binary, low binary, cell int"
_FOUND = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64())), ("vector", pa.binary()), ("low", pa.binary()), ("bound", pa.float64()), ("visit", pa.list_(pa.int32()))])
_FOUND_DDL = "vec_id long, ids array<long>, dists array<double>, vector binary, low binary, bound double, visit array<int>"
_PART = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64()))])
_PART_DDL = "vec_id long, ids array<long>, dists array<double>"


def chi2_cdf(x: float, m: int) -> float:
    a, x = m / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 4.0 * m + 100
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dims: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, m))


def planes(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Median splits of the widest dimension, as a heap: node i has children 2 i + 1 and 2 i + 2."""
    out: list[tuple[int, float]] = []
    level = [points]
    while len(out) + 1 < cells:
        after = []
        for p in level:
            if len(p):
                d = int(np.argmax(p.max(0) - p.min(0)))
                v = float(np.median(p[:, d]))
            else:
                d, v = 0, 0.0
            out.append((d, v))
            after += [p[p[:, d] < v], p[p[:, d] >= v]]
        level = after
    return out


def cell_of(points: np.ndarray, planes_: list[tuple[int, float]]) -> np.ndarray:
    if not planes_:
        return np.zeros(len(points), np.int32)
    dim, cut_at = np.array([p[0] for p in planes_]), np.array([p[1] for p in planes_])
    node = np.zeros(len(points), np.int64)
    for _ in range((len(planes_) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), dim[node]] >= cut_at[node])
    return (node - len(planes_)).astype(np.int32)


class Tree:
    """A kd-tree of projected points whose leaves hold ids and vectors contiguously."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, leaf: int = LEAF):
        order, bounds, stack = [], [0], [np.arange(len(ids))]
        while stack:
            at = stack.pop()
            wide = low[at].max(0) - low[at].min(0)
            if len(at) <= leaf or not wide.max() > 0:
                for lo in range(0, len(at), leaf):  # equal points: leaves of the same place
                    order.append(at[lo : lo + leaf])
                    bounds.append(bounds[-1] + len(order[-1]))
                continue
            d = int(np.argmax(wide))
            half = len(at) // 2
            part = np.argpartition(low[at, d], half)
            stack += [at[part[half:]], at[part[:half]]]
        order = np.concatenate(order)
        self.ids, self.vectors, self.low, self.bounds = ids[order], vectors[order], low[order], np.array(bounds)
        self.norms = (self.vectors**2).sum(1)
        self.mins = np.minimum.reduceat(self.low, self.bounds[:-1])
        self.maxs = np.maximum.reduceat(self.low, self.bounds[:-1])

    def leaf(self, k: int) -> slice:
        return slice(self.bounds[k], self.bounds[k + 1])


def gaps(low: np.ndarray, mins: np.ndarray, maxs: np.ndarray) -> np.ndarray:
    """[points, boxes] squared distances of points from boxes."""
    out = np.zeros((len(low), len(mins)))
    for d in range(low.shape[1]):
        x = low[:, d, None]
        out += np.maximum(np.maximum(mins[None, :, d] - x, x - maxs[None, :, d]), 0) ** 2
    return out


def search(tree: Tree, vectors: np.ndarray, low: np.ndarray, bound: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) [queries, k] of the nearest, within the squared distances `bound`;
    places that are left over have id -1 and distance inf. Leaves come by rising distance from the
    queries, which are neighbours of each other; one that is out of a query's reach is not verified for it."""
    n = len(vectors)
    best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1)
    worst = bound.copy()
    norm = (vectors**2).sum(1)
    reach = gaps(low, tree.mins, tree.maxs)
    near = reach.min(0)
    for leaf in np.argsort(near, kind="stable"):
        if near[leaf] > stop * worst.max():
            break
        at = np.flatnonzero(reach[:, leaf] <= stop * worst)
        if not len(at):
            continue
        own = tree.leaf(leaf)
        d = vectors[at] @ tree.vectors[own].T
        d *= -2
        d += tree.norms[own]
        d += norm[at, None]
        hit = np.flatnonzero(d.min(1) <= worst[at] + 1e-12)
        if not len(hit):
            continue
        at, d = at[hit], np.round(np.maximum(d[hit], 0), 12)
        d[d > worst[at, None] + 1e-12] = np.inf
        all_d = np.concatenate([best_d[at], d], axis=1)
        all_i = np.concatenate([best_i[at], np.broadcast_to(tree.ids[own], d.shape)], axis=1)
        order = np.lexsort((all_i, all_d), axis=1)[:, :k]
        best_d[at], best_i[at] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        worst[at] = np.minimum(worst[at], best_d[at, -1])
    best_i[~np.isfinite(best_d)] = -1
    return best_i, best_d


class Boxes:
    """The boxes of the cells and of the nodes above them, as a heap."""

    def __init__(self, mins: np.ndarray, maxs: np.ndarray):
        if len(mins) & (len(mins) - 1):
            raise ValueError("cells must be a power of 2")
        low, high = [mins], [maxs]
        while len(low[0]) > 1:
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        self.mins, self.maxs = low, high

    def within(self, low: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the cells whose box is within the squared distance `reach` of a query, by query."""
        row, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        for mins, maxs in zip(self.mins, self.maxs, strict=True):
            if len(mins) > 1:
                row, node = np.repeat(row, 2), np.repeat(node * 2, 2)
                node[1::2] += 1
            x = low[row]
            ok = (np.maximum(np.maximum(mins[node] - x, x - maxs[node]), 0) ** 2).sum(1) <= reach[row]
            row, node = row[ok], node[ok]
        return row, node


def _rows(ids: np.ndarray, best_i: np.ndarray, best_d: np.ndarray, schema: pa.Schema, *more) -> pa.RecordBatch:
    ok = np.isfinite(best_d)
    off = pa.array(np.concatenate([[0], np.cumsum(ok.sum(1))]), pa.int32())
    return batch(schema, ids, pa.ListArray.from_arrays(off, pa.array(best_i[ok])), pa.ListArray.from_arrays(off, pa.array(np.sqrt(best_d[ok]))), *more)


def _floats(column: pa.Array, kind=np.float64) -> np.ndarray:
    """[rows, numbers] of a column of equally long byte strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind).reshape(len(column), -1).astype(np.float64)


def _bytes(x: np.ndarray) -> pa.Array:
    """The opposite of _floats."""
    x = np.ascontiguousarray(x)
    off = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(x)])


def _groups(batches, *keys: str):
    """Tables of the rows of one key each; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ks = [b.column(k).to_numpy() for k in keys]
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in ks])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and any(held[-1].column(c)[0].as_py() != k[lo] for c, k in zip(keys, ks, strict=True)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _project(matrix: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("ask", pa.bool_()), ("vector", pa.binary()), ("low", pa.binary())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = b.column("v")
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(v), -1)
                yield batch(schema, b.column("vec_id"), b.column("ask"), _bytes(x), _bytes(x.astype(np.float64) @ matrix))

    return run


def _assign(planes_):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield batch(_POINT, *(b.column(c) for c in ("vec_id", "ask", "vector", "low")), cell_of(_floats(b.column("low")), planes_))

    return run


def _tree(t: pa.Table) -> Tree:
    return Tree(t.column("vec_id").to_numpy(), _floats(t.column("vector"), np.float32), _floats(t.column("low")))


def _near(tree: Tree, t: pa.Table):
    """Slices of at most LEAF queries that lie near each other: (their rows, vectors, projections)."""
    low = _floats(t.column("low"))
    leaf = np.concatenate([gaps(low[i : i + LEAF], tree.mins, tree.maxs).argmin(1) for i in range(0, len(low), LEAF)])
    order = np.argsort(leaf, kind="stable")
    for i in range(0, len(order), LEAF):
        part = t.take(pa.array(order[i : i + LEAF]))
        yield part, _floats(part.column("vector"), np.float32), _floats(part.column("low"))


def _own(k: int, stop: float, boxes: Boxes):
    """Rows sorted by cell. Answers each cell's queries from its own points; says which other cells each
    still has to visit."""

    def run(batches):
        for t in _groups(batches, "cell"):
            asks = t.filter(t.column("ask"))
            if not asks.num_rows:
                continue
            cell, tree = t.column("cell")[0].as_py(), _tree(t)
            for part, v, p in _near(tree, asks):
                i, d = search(tree, v, p, np.full(len(v), np.inf), k, stop)
                bound = d[:, -1]
                row, to = boxes.within(p, stop * bound)
                row, to = row[to != cell], to[to != cell]
                off = pa.array(np.searchsorted(row, np.arange(len(v) + 1)), pa.int32())
                visit = pa.ListArray.from_arrays(off, pa.array(to.astype(np.int32)))
                yield _rows(part.column("vec_id").to_numpy(), i, d, _FOUND, _bytes(v.astype(np.float32)), _bytes(p), bound, visit)

    return run


def _visit(k: int, stop: float):
    """Rows sorted by (cell, slice): the cell's points, whose bound is -inf, and the queries that visit it."""

    def run(batches):
        for t in _groups(batches, "cell", "slice"):
            own = np.isneginf(t.column("bound").to_numpy())
            points, queries = t.filter(pa.array(own)), t.filter(pa.array(~own))
            if not queries.num_rows or not points.num_rows:
                continue
            tree = _tree(points)
            for part, v, p in _near(tree, queries):
                i, d = search(tree, v, p, part.column("bound").to_numpy().copy(), k, stop)
                yield _rows(part.column("vec_id").to_numpy(), i, d, _PART)

    return run


def _boxes(batches):
    schema = pa.schema([("cell", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
    for b in batches:
        if b.num_rows:
            low, cell = _floats(b.column("low")), b.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            low, cell = low[order], cell[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            yield batch(schema, cell[first], np.minimum.reduceat(low, first).tolist(), np.maximum.reduceat(low, first).tolist())


def _among(points: DataFrame, dims: int, k: int, m: int, p: float, cell_rows: int, seed: int) -> DataFrame:
    """(q, id, distance): at least the k nearest points of each point that asks, itself among them.
    points: (vec_id, ask, v), all different vectors of `dims` numbers."""
    spark = points.sparkSession
    stop = chi2_quantile(p, m)
    points = cut(points.mapInArrow(tidy(_project(projection(dims, m, seed))), "vec_id long, ask boolean, vector binary, low binary"))
    cells = min(MAX_CELLS, 1 << max(0, math.ceil(math.log2(max(1, points.count() / cell_rows)))))
    sample = points.select("vec_id", "low").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, SAMPLE_PER_CELL * cells)).toArrow()
    cutting = planes(_floats(sample.column("low")), cells)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = cut(points.mapInArrow(tidy(_assign(cutting)), _POINT_DDL))
    ends = [[F.expr(f"{f}({c}[{i}])").alias(f"{c}{i}") for i in range(m)] for f, c in (("min", "lo"), ("max", "hi"))]
    got = points.mapInArrow(tidy(_boxes), "cell int, lo array<double>, hi array<double>").groupBy("cell").agg(*ends[0], *ends[1]).toPandas()  # a row per cell
    mins, maxs = np.full((cells, m), np.inf), np.full((cells, m), -np.inf)
    mins[got["cell"]], maxs[got["cell"]] = got[[f"lo{i}" for i in range(m)]], got[[f"hi{i}" for i in range(m)]]
    boxes = Boxes(np.where(np.isinf(mins), 1e150, mins), np.where(np.isinf(maxs), -1e150, maxs))  # empty cells are nowhere
    found = cut(points.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(tidy(_own(k, stop, boxes)), _FOUND_DDL))
    asks = found.select("vec_id", "vector", "low", F.explode("visit").alias("cell"), "bound")
    slices = cut(asks.groupBy(F.col("cell").alias("to")).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("slices")))  # at most MAX_CELLS rows
    slices = F.broadcast(slices)
    asks = asks.join(slices, F.col("cell") == F.col("to")).withColumn("slice", F.pmod(F.xxhash64("vec_id"), "slices").cast("int"))
    there = points.join(slices, F.col("cell") == F.col("to")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("bound", F.lit(float("-inf")))
    columns = ["vec_id", "vector", "low", "cell", "slice", "bound"]
    met = there.select(*columns).unionByName(asks.select(*columns)).repartition(n, "cell", "slice").sortWithinPartitions("cell", "slice")
    more = met.mapInArrow(tidy(_visit(k, stop)), _PART_DDL)
    rows = found.select("vec_id", "ids", "dists").unionByName(more).select(F.col("vec_id").alias("q"), F.explode(F.arrays_zip("ids", "dists")).alias("x"))
    return rows.select("q", F.col("x.ids").alias("id"), F.round("x.dists", 6).alias("distance"))


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, m: int = M, p: float = P, cell_rows: int = CELL_ROWS, seed: int = 7, key: str = "vec_id", column: str = "embedding", ask: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest of each vector that `ask` selects (None: of
    all), rank 1 the nearest."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<float>").alias("v"), F.coalesce(F.lit(True) if ask is None else ask, F.lit(False)).alias("ask"))
    v = v.where("vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    v = v.where(F.size("v") == dims["d"]).groupBy("vec_id").agg(F.min("v").alias("v"), F.bool_or("ask").alias("ask"))
    v = cut(v.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float"))))  # -0 is 0
    classes = cut(v.groupBy(F.col("v").alias("w")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.bool_or("ask").alias("asked")).where("n > 1"))
    if classes.isEmpty():
        rows = _among(v, dims["d"], k + 1, m, p, cell_rows, seed).where("q <> id")
    else:
        same = maybe_broadcast(classes, CLASSES)
        copies = cut(v.join(same, F.col("v") == F.col("w")).select("vec_id", "rep", "ask"))
        points = v.join(same, F.col("v") == F.col("w"), "left").where("rep is null or rep = vec_id").select("vec_id", F.coalesce("asked", "ask").alias("ask"), "v")
        first = Window.partitionBy("rep").orderBy("vec_id")  # each task keeps k + 1 of a class before the shuffle
        members = copies.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1).select(F.col("rep").alias("r"), F.col("vec_id").alias("member"))
        asked = copies.where("ask").select(F.col("rep").alias("s"), F.col("vec_id").alias("asker"))
        got = cut(_among(points, dims["d"], k + 1, m, p, cell_rows, seed))
        got = got.join(maybe_broadcast(cut(members)), F.col("id") == F.col("r"), "left").select("q", F.coalesce("member", "id").alias("id"), "distance")
        order = Window.partitionBy("q").orderBy("distance", "id")  # before hot classes of askers take their copies
        got = got.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).drop("i")
        rows = got.join(maybe_broadcast(cut(asked)), F.col("q") == F.col("s"), "left").select(F.coalesce("asker", "q").alias("q"), "id", "distance").where("q <> id")
    order = Window.partitionBy("q").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), "distance")

"""Nearest neighbours by low-dimensional stable projections in a kd-tree.

Unit vectors are projected on a few Gaussian directions. The squared projected distance of two
vectors, divided by their squared distance, is chi-square distributed with as many degrees of freedom
as there are directions. A query takes points in the order of their projected distance and verifies
them on the original vectors, until the chi-square test says that a point this far in projection is
nearer than the current k-th best with small probability only.

The top of the kd-tree, fitted on a bounded sample, deals all points to cells; each cell's rest of the
tree is built by the task that holds the cell. A query searches its own cell first and then, with the
bound found there, the cells that the test cannot rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorspark.llm.common import small_batches, via_table

DIRECTIONS = 8
#: The test's level: a true neighbour is passed over with the chance 1 - LEVEL at most.
LEVEL = 0.96
#: Points of a cell, about, while the sample can tell so many cells apart.
CELL_ROWS = 4096
#: Rows of the sample that places the cells' borders, and of those that a cell's borders rest on: bounds,
#: whatever the input.
SAMPLE_ROWS, ROWS_A_CELL = 8192, 8
#: Points and queries that one task holds, at most about: larger cells and more queries are cut to blocks,
#: and every block of a cell's points meets every block of its queries.
BLOCK_ROWS = 16_384
LEAF = 64
#: Queries whose distances to all leaves are held at once.
_AT_ONCE = 512
#: Float32 cosines may be off by so much; what is that close to the bound is computed in doubles.
_SLACK = 1e-4


def chi_square_quantile(level: float, freedom: int) -> float:
    """For an even number of degrees of freedom: its distribution is 1 - exp(-x/2) sum (x/2)^i / i!."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
        low, high = (x, high) if below < level else (low, x)
    return high


def directions(dim: int, m: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Tree:
    """Borders of a kd-tree of ``depth`` levels: inner node i splits ``axis[i]`` at ``at[i]``; its
    children are 2i + 1 and 2i + 2. Cells are numbered from the left."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = [np.arange(len(points))]
        node = 0
        for _ in range(depth):
            below = []
            for rows in parts:
                if len(rows):
                    spread = points[rows].max(axis=0) - points[rows].min(axis=0)
                    self.axis[node] = int(spread.argmax())
                    self.at[node] = float(np.median(points[rows, self.axis[node]]))
                left = points[rows, self.axis[node]] < self.at[node]
                below += [rows[left], rows[~left]]
                node += 1
            parts = below

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - ((1 << self.depth) - 1)

    def boxes(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = [np.full(m, -np.inf)], [np.full(m, np.inf)]
        for node in range((1 << self.depth) - 1):
            a, b = low[node].copy(), high[node].copy()
            a[self.axis[node]], b[self.axis[node]] = self.at[node], self.at[node]
            low += [low[node], a]
            high += [b, high[node]]
        return np.array(low[-(1 << self.depth) :]), np.array(high[-(1 << self.depth) :])


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes (points x boxes)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
    return out


def cosines(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Row by row, so that equal rows give equal bits wherever they stand."""
    return (rows * query).sum(axis=1) / (norms * norm)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    parts, out = [np.arange(len(points))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        axis = int((points[rows].max(axis=0) - points[rows].min(axis=0)).argmax())
        order = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
        parts += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def search_cell(
    vectors: np.ndarray, low_ids: np.ndarray, projected: np.ndarray, queries: np.ndarray, placed: np.ndarray,
    bounds: np.ndarray, k: int, quantile: float,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best points of the cell (row numbers and cosines, best first, ties to the
    smaller id) as far as the test lets them be looked at. ``bounds``: cosines known to be reached by
    k points already, -inf if none."""
    leaves = _leaves(projected)
    order = np.concatenate(leaves)
    sizes = np.array([len(x) for x in leaves])
    first = np.concatenate([[0], np.cumsum(sizes)])
    low = np.array([projected[x].min(axis=0) for x in leaves])
    high = np.array([projected[x].max(axis=0) for x in leaves])
    norms, query_norms = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    # Leaf by leaf in memory, so that a leaf is a slice.
    rough = np.ascontiguousarray(vectors[order] / norms[order, None], dtype=np.float32)
    asked = np.ascontiguousarray(queries / query_norms[:, None], dtype=np.float32)
    there = projected[order]
    out = []
    for q in range(len(queries)):
        if q % _AT_ONCE == 0:
            away = box_distances(placed[q : q + _AT_ONCE], low, high)
        best, score = np.zeros(0, np.int64), np.zeros(0)
        kth = bounds[q]
        mine = away[q % _AT_ONCE]
        near = np.argsort(mine, kind="stable")
        at, step = 0, 2
        while at < len(near):
            radius = quantile * max(0.0, 2 - 2 * kth) + 1e-12
            chunk = near[at : at + step]
            chunk = chunk[mine[chunk] <= radius]
            if not len(chunk):
                break
            at, step = at + step, min(2 * step, 16)
            held = np.concatenate([np.arange(first[c], first[c + 1]) for c in chunk])
            if np.isfinite(radius):
                held = held[((there[held] - placed[q]) ** 2).sum(axis=1) <= radius]
                # Verified roughly first: only what may be among the best is computed in doubles.
                held = held[rough[held] @ asked[q] >= kth - _SLACK]
            if not len(held):
                continue
            rows = order[held]
            best = np.concatenate([best, rows])
            score = np.concatenate([score, cosines(vectors[rows], norms[rows], queries[q], query_norms[q])])
            keep = np.lexsort((low_ids[best], -score))[:k]
            best, score = best[keep], score[keep]
            if len(best) == k:
                kth = max(kth, score[-1])
        out.append((best, score))
    return out


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, m: int = DIRECTIONS, level: float = LEVEL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``vec_id, embedding``: for each row that ``is_query``
    names the k largest cosines found among all other rows, ties to the smaller id.

    Vectors that are null, zero or have null or non-finite components take no part, neither do null
    ids and vectors of another length than most. Rows that agree in id and vector are one row; a
    query meets no row of its own id. Equal vectors are one point with its k + 1 smallest ids, so a
    frequent vector is indexed and searched once. Empty input gives an empty result. A task holds about
    ``block_rows`` points and as many queries, however many there are.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), clean.alias("v"), is_query.alias("ask"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    dim = shape["d"]
    rows = rows.where(F.size("v") == dim).groupBy("vec_id", "v").agg(F.max("ask").alias("ask")).withColumn("node", F.xxhash64("v"))
    rows = via_table(rows, "nearest-rows")
    # The k + 1 smallest ids of each vector: the limit is taken before rows of a vector meet.
    small = rows.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = small.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    points = via_table(points, "nearest-points")
    asked = via_table(rows.where("ask").select(F.col("vec_id").alias("query_id"), "node"), "nearest-queries")

    n = points.count()
    project = directions(dim, m)
    depth = max(0, math.ceil(math.log2(max(1, min(n / CELL_ROWS, SAMPLE_ROWS / ROWS_A_CELL)))))
    chance = F.xxhash64("node", F.lit(1)) / F.lit(float(1 << 64)) + 0.5
    sample = points.where(chance < SAMPLE_ROWS / max(n, 1)).select("v").toPandas()["v"]
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    tree = Tree(unit(np.stack(sample)) @ project if len(sample) else np.zeros((0, m)), depth)
    low, high = tree.boxes(m)
    quantile = chi_square_quantile(level, m)

    def array_of(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy().reshape(-1, dim)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.cell(unit(array_of(batch.column("v"))) @ project) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    points = via_table(points.mapInArrow(dealt, "node long, ids array<long>, v array<double>, cell int"), "nearest-cells")
    # How many blocks each cell's points take: one row a cell, and there are at most so many cells.
    held = {r["cell"]: -(-r["count"] // block_rows) for r in points.groupBy("cell").count().collect()}
    blocks = np.array([held.get(c, 0) for c in range(1 << depth)])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with every other cell that its bound cannot rule out."""
        for batch in batches:
            at = unit(array_of(batch.column("v"))) @ project
            bound, home = batch.column("bound").to_numpy(), batch.column("cell").to_numpy()
            reach = box_distances(at, low, high) <= (quantile * np.maximum(0, 2 - 2 * bound) + 1e-12)[:, None]
            reach[np.arange(len(home)), home] = False
            q, cell = np.nonzero(reach)
            part = batch.select(["node", "v", "bound"]).take(pa.array(q))
            yield part.append_column("cell", pa.array(cell.astype(np.int32)))

    def find(key: tuple, held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": [], "vec_id": [], "score": []}).astype({"node": "int64", "vec_id": "int64", "score": "float64"})
        if not len(held) or not len(queries):
            return none
        v, q = np.stack(held["v"]), np.stack(queries["v"])
        ids = held["ids"].tolist()
        found = search_cell(
            v, np.array([i[0] for i in ids]), unit(v) @ project, q, unit(q) @ project, queries["bound"].to_numpy(), k + 1, quantile
        )
        out = []
        for node, (best, score) in zip(queries["node"], found, strict=True):
            got = sorted(((-s, i) for b, s in zip(best.tolist(), score.tolist(), strict=True) for i in ids[b]))[: k + 1]
            out += [(node, i, -s) for s, i in got]
        return pd.DataFrame(out, columns=["node", "vec_id", "score"]).astype(none.dtypes) if out else none

    found_schema = "node long, vec_id long, score double"
    ask = points.join(asked.select("node").distinct(), "node", "left_semi")

    def searched(queries: DataFrame) -> DataFrame:
        """Every block of a cell's points with every block of the queries that reach the cell."""
        counts = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
        of_points = F.element_at(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), F.col("cell") + 1)
        of_queries = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(c, 0) // block_rows))) for c in range(len(blocks))]), F.col("cell") + 1)
        place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        p = points.withColumns({"pb": place(2, of_points), "qb": every(of_queries)}) if counts else points.withColumns({"pb": F.lit(0), "qb": F.lit(0)})
        q = queries.withColumn("qb", place(3, of_queries)).withColumn("pb", every(of_points))
        keys = ["cell", "pb", "qb"]
        return p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(find, found_schema)

    first = via_table(searched(ask.select("node", "v", "cell", F.lit(float("-inf")).alias("bound")).toDF("node", "v", "cell", "bound")), "nearest-first")
    # The worst of the best k + 1 of its own cell is a query's bound; fewer bound nothing.
    own = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    bounds = first.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1)
    bounds = bounds.groupBy("node").agg(F.when(F.count("score") > k, F.min("score")).otherwise(float("-inf")).alias("bound"))
    wide = ask.join(bounds, "node").select("node", "v", "bound", "cell").mapInArrow(around, "node long, v array<double>, bound double, cell int")
    every = first.union(searched(wide))
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    best = via_table(every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), "nearest-best")
    mine = asked.join(best, "node").where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

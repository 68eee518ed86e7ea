"""Approximate nearest neighbours by cosine: stable projections, kd-trees, and a chi-square stopping test.

Vectors of length 1 are ordered by distance as by cosine.  Each block of rows is projected to `dims` Gaussian dimensions
and indexed by a kd-tree.  A query takes the leaves of a block in the order of their projected distance; every point whose
projected distance is below the bound of the leaves to come is verified on the original vectors.  For a point at distance
d, (projected distance / d)**2 is chi-square with `dims` degrees of freedom.  The search of a block stops when a point
nearer than the k-th best so far would, with probability `confidence`, have been seen already.

Every row is indexed.  Of equal vectors only the first k + 1 ids can be among any k nearest, so the others need no place.
Queries, in groups, meet all blocks; the k best of each block are merged by a ranking that is cut before its shuffle.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, neither as queries nor as
candidates; vectors of different lengths are never compared.  Rows that share an id are one row each; a query leaves out
all rows of its own id.  With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS, CONFIDENCE = 8, 0.95
LEAF_POINTS, BLOCK_POINTS, GROUP_QUERIES = 32, 8192, 4096
# Leaves that a query takes at a time.
STEP_LEAVES = 16

NEAREST = "query_id long, vec_id long, score double"


def chi_square(x: float, dims: int) -> float:
    """The distribution function, for an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))


def chi_square_point(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


class KdTree:
    """Leaves of a kd-tree: the order of the points, the bounds of the leaves in it, and their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_POINTS) -> None:
        self.order = np.arange(len(points))
        cuts, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                cuts.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.leaves = np.array(sorted(cuts), np.int64)
        ranked = points[self.order]
        self.low = np.minimum.reduceat(ranked, self.leaves[:, 0], axis=0)
        self.high = np.maximum.reduceat(ranked, self.leaves[:, 0], axis=0)

    def bounds(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to the box of each leaf."""
        away = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.einsum("ij,ij->i", away, away)


class Index:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.repeated = len(np.unique(ids)) < len(ids)
        self.projection = projection
        points = self.vectors @ projection
        self.tree = KdTree(points)
        self.ids, self.vectors, self.points = self.ids[self.tree.order], self.vectors[self.tree.order], points[self.tree.order]

    def nearest(self, own_id: int, vector: np.ndarray, k: int, enough: float) -> list[tuple[float, int]]:
        """The k best found (score, id), best first; `enough` is the chi-square point of the stopping test."""
        vector = vector / np.linalg.norm(vector)
        point = vector @ self.projection
        bounds = self.tree.bounds(point)
        turn = np.argsort(bounds, kind="stable")
        best: list[tuple[float, int]] = []
        waiting, waiting_d = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(turn), STEP_LEAVES):
            rows = np.concatenate([np.arange(a, b) for a, b in self.tree.leaves[turn[at:at + STEP_LEAVES]]])
            away = self.points[rows] - point
            waiting = np.concatenate([waiting, rows])
            waiting_d = np.concatenate([waiting_d, np.einsum("ij,ij->i", away, away)])
            bound = bounds[turn[at + STEP_LEAVES]] if at + STEP_LEAVES < len(turn) else np.inf
            ready = waiting_d <= bound
            seen, waiting, waiting_d = waiting[ready], waiting[~ready], waiting_d[~ready]
            scores, ids = self.vectors[seen] @ vector, self.ids[seen]
            if len(best) == k:
                better = scores >= best[-1][0]
                scores, ids = scores[better], ids[better]
            best = sorted(best + [(s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != own_id], key=lambda x: (-x[0], x[1]))
            if self.repeated:
                # Of rows that share an id the nearest counts.
                best = sorted(((s, i) for i, s in {i: s for s, i in reversed(best)}.items()), key=lambda x: (-x[0], x[1]))
            best = best[:k]
            if len(best) == k and bound >= enough * max(0.0, 2.0 - 2.0 * best[-1][0]):
                break
        return best


def projection(length: int, dims: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((length, dims))


def _vectors(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _searcher(k: int, dims: int, confidence: float):
    enough = chi_square_point(confidence, dims)

    def search(key, rows, queries):
        out: list[tuple[int, int, float]] = []
        if rows.num_rows and queries.num_rows:
            vectors = _vectors(rows.column("vector"), rows.num_rows)
            index = Index(rows.column("vec_id").to_numpy(), vectors, projection(vectors.shape[1], dims))
            asked = _vectors(queries.column("q_vector"), queries.num_rows)
            for own_id, vector in zip(queries.column("query_id").to_pylist(), asked):
                out += [(own_id, i, s) for s, i in index.nearest(own_id, vector, k, enough)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    return search


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", dims: int = DIMS,
            confidence: float = CONFIDENCE, block_points: int = BLOCK_POINTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest ids found for each id with a row for which `is_query` holds.

    Rows that share an id are one candidate, as near as the nearest of them; none of them is found for a query of that id.
    """
    vectors = rows.withColumn("_ask", is_query).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), "_ask",
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    queries = vectors.filter("_ask").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"), F.col("dim").alias("q_dim"))
    # Rows alike in id and vector are one candidate; of equal vectors the k + 1 smallest ids are enough.
    first = Window.partitionBy("vector").orderBy("vec_id")
    kept = vectors.select("vec_id", "vector", "dim").distinct().withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") <= k + 1).drop("_copy")
    blocks = max(1, -(-rows.count() // block_points))
    groups = max(1, -(-queries.count() // GROUP_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = kept.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("group", every(groups))
    right = queries.withColumn("q_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("q_block", every(blocks))
    found = left.groupBy("dim", "block", "group").cogroup(right.groupBy("q_dim", "q_block", "q_group")).applyInArrow(
        _searcher(k, dims, confidence), NEAREST)
    # A query that stands in several rows is asked with each of its vectors.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by stable projections in a kd-tree, with a chi-square stopping test.

The largest inner product becomes the smallest distance: vectors get one more coordinate that brings them all to the
largest norm, queries are scaled to that norm. A Gaussian (2-stable) projection to ``dims`` coordinates turns a squared
distance d into d times a chi-square variable of ``dims`` degrees (the SRS method of Sun and others, 2014). Each block of
vectors has a kd-tree over its projections. A query takes the leaves by the projected distance to their boxes, verifies
their vectors on the originals, and stops when that distance exceeds what a vector nearer than the k-th found would
show with the given confidence. Blocks of vectors meet blocks of queries, so no task holds more than one of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import written

#: Projected coordinates, points of a leaf, and the chance with which each true neighbour is to be seen.
DIMS, LEAF, CONFIDENCE = 16, 64, 0.97
#: Rows of a block of vectors and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 20_000, 10_000


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p."""
    low, high = 0.0, 1000.0 + 10 * dims
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


class ProjectedTree:
    """A kd-tree over projected points: rows in leaf order, and the leaves' boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append(np.sort(rows))
                continue
            part = points[rows]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = len(rows) // 2
            cut = np.argsort(part[:, axis], kind="stable")
            todo += [rows[cut[half:]], rows[cut[:half]]]
        self.low = np.stack([points[r].min(axis=0) for r in self.leaves])
        self.high = np.stack([points[r].max(axis=0) for r in self.leaves])

    def by_distance(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves and the squared distances to their boxes, nearest first."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        d = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, norm: float, dims: int = DIMS, confidence: float = CONFIDENCE) -> list[tuple[int, int, float]]:
    """(query, id, score) of the k largest inner products that each query finds in a block. ids ascend."""
    rng = np.random.default_rng(20_240_131)
    plane = rng.normal(size=(vectors.shape[1] + 1, dims))
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0))
    tree = ProjectedTree(vectors @ plane[:-1] + rest[:, None] * plane[-1])
    rows = np.concatenate(tree.leaves)
    ids, vectors = ids[rows], vectors[rows]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in tree.leaves])))
    limit = chi_square_quantile(confidence, dims)
    found = []
    for query_id, q in zip(query_ids.tolist(), queries, strict=True):
        scale = norm / math.sqrt(q @ q)
        order, near = tree.by_distance((q * scale) @ plane[:-1])
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(order):
            kth = best[k - 1] if len(best) >= k else -np.inf
            if len(best) >= k and near[at] > limit * max(0.0, 2 * norm * norm - 2 * scale * kth):
                break
            some = np.concatenate([np.arange(bounds[x], bounds[x + 1]) for x in order[at : at + step]])
            at, step = at + step, min(64, step * 2)
            some = some[ids[some] != query_id]
            rough = vectors[some] @ q
            some = some[rough >= kth - 1e-9 * (1 + abs(kth))] if len(best) >= k else some
            exact = (vectors[some] * q).sum(axis=1)  # the same order of summation for each row: equal vectors tie
            best_id, best = np.concatenate((best_id, ids[some])), np.concatenate((best, exact))
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
        found += [(query_id, i, s) for i, s in zip(best_id.tolist(), best.tolist(), strict=True)]
    return found


def usable(vector: Column) -> Column:
    """Vectors with finite components that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, dims: int = DIMS, confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner products that each query row finds.

    vectors has vec_id and embedding; is_query is a condition on them. A row is never its own neighbour, nor are rows
    that repeat its id. Null, zero and non-finite vectors, null ids, and vectors of another length than
    most (the longer, of equally many) take no part. Ties go to the smaller vec_id; rows that repeat an id each count. Every
    row is indexed. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("asked"))
    main = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, vec_id long, score double"
    if main is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    kept = written(rows.filter(F.size("v") == main.d).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "vectors")
    norm = math.sqrt(kept.agg(F.max("norm2")).first()[0])
    blocks, parts = max(1, -(-main.n // block_rows)), max(1, -(-(main.asked or 0) // query_rows))
    dealt = kept.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("p", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = dealt.select("b", every(parts).alias("p"), "vec_id", "v")
    right = dealt.filter("q").select("p", every(blocks).alias("b"), "vec_id", "v")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat[order]

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        found = search_block(*matrix(block), *matrix(asked), k, norm, dims, confidence) if len(block) and len(asked) else []
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    met = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

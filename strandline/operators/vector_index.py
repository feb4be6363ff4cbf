"""Exact vector search over clustered rows: a shell of vectors that the triangle inequality rules out is never multiplied.

Vectors are assigned to centroids (fitted on a bounded sample; every vector is assigned) and sorted by their distance to it, so that
what a task reads together are shells around centroids, each with a nearest and a farthest distance. A query at distance d
from the centroid is at least max(d - farthest, nearest - d) from every vector of the shell. A task gives each query its likeliest
shell first, whose k-th score is a threshold, and then those shells whose bound reaches it; shells and queries meet as matrices.
A search for all vectors, not the k best, gives a block's pairs out before it makes the next one's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.kept import content_key, kept
from ..sources.tables import stored
from .arrow import released
from .retrieval import top

#: Centroids at most, sampled vectors for each, rounds of fitting, vectors of a shell or assigned at once, queries searched together.
CENTROIDS, SAMPLED, ROUNDS, SHELL, QUERIES = 1024, 16, 5, 1024, 4096
#: Pairs of query and vector that a task holds, where all are asked for.
PAIRS = 1 << 18
#: What rounding may add to a score.
SLACK = 2e-6
#: score: from inner product s and squared distance d2, and the best that a distance of at least d allows.
MEASURES = {
    "cosine": (lambda s, d2: s, lambda d: (2 - d * d) / 2),
    "distance": (lambda s, d2: np.maximum(0, 1 - np.sqrt(np.maximum(d2, 0)) / 2), lambda d: np.maximum(0, 1 - d / 2)),
}


@dataclass(frozen=True)
class VectorIndex:
    """rows: vec_id, v, cluster, distance, and other columns, in order."""

    rows: DataFrame
    centroids: np.ndarray
    measure: str


def _points(vectors: DataFrame, id_col: str, vector_col: str, measure: str, *also: str) -> DataFrame:
    """id and v, doubles, of unit length for cosines (zero stays zero), and other columns; without null vectors, components and ids."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col), v.alias("v"), *also).filter(F.col(id_col).isNotNull() & F.coalesce(F.forall("v", lambda c: c.isNotNull()), F.lit(False)))
    if measure == "cosine":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
        rows = rows.withColumn("length", length).select(id_col, F.transform("v", lambda c: F.when(F.col("length") > 0, c / F.col("length")).otherwise(0.0)).alias("v"), *also)
    return rows


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(square, 0))


def fit_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of a sample; a centroid that nothing is nearest to stays."""
    centroids = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        nearest = _distances(sample, centroids).argmin(axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(nearest, minlength=count)
        np.add.at(sums, nearest, sample)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def build(vectors: DataFrame, measure: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", name: str = "vectors", also: tuple[str, ...] = ()) -> VectorIndex:
    """The index of vectors of one length, kept by content. Null vectors and ids take no part, nor do vectors of another length than
    the longest. also: columns that a search for all gives with each vector. The driver holds the centroids and the sample they are fitted on, whose sizes are bounded."""
    spark = vectors.sparkSession
    points = _points(vectors, id_col, vector_col, measure, *also).withColumnRenamed(id_col, "vec_id")
    key = "-".join([name, measure, *also, content_key(vectors.select(id_col, vector_col, *also))])
    n, dims = points.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    dims = max(1, dims)
    points = points.filter(F.size("v") == dims)
    count = max(1, min(CENTROIDS, round(n**0.5)))
    sample = points.select("vec_id", "v").orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLED * count).collect()  # bounded
    centroids = fit_centroids(np.array([r.v for r in sample]), count) if sample else np.zeros((1, dims))
    schema = StructType([points.schema["vec_id"], *StructType.fromDDL("v array<double>, cluster int, distance double"), *[points.schema[c] for c in also]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SHELL) for b in batches for at in range(0, b.num_rows, SHELL)):
            d = _distances(_matrix(batch.column(1), dims), centroids)
            nearest = d.argmin(axis=1)
            distance = d[np.arange(len(d)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nearest, pa.int32()), pa.array(distance), *batch.columns[2:]], schema=to_arrow_schema(schema))

    def rows() -> DataFrame:
        near = stored(points.mapInArrow(released(assign), schema), "assigned")
        order = ["cluster", "distance", "vec_id"]
        return near.repartitionByRange(*order).sortWithinPartitions(*order)

    return VectorIndex(kept(spark, f"{key}-rows", rows), centroids, measure)


def _shells(clusters: np.ndarray, distances: np.ndarray, queries: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Rows in order of cluster and distance: where their shells begin and end; and how near each shell is to each query at least."""
    cuts = np.flatnonzero(np.append(True, np.diff(clusters) != 0))
    ends = [*cuts[1:].tolist(), len(clusters)]
    shells = [(x, min(x + SHELL, b)) for a, b in zip(cuts.tolist(), ends, strict=True) for x in range(a, b, SHELL)]
    near, far = (np.array([distances[s[0]] for s in shells]), np.array([distances[s[1] - 1] for s in shells]))
    present, place = np.unique([clusters[a] for a, _ in shells], return_inverse=True)
    d = _distances(queries, centroids[present])[:, place]
    return shells, np.maximum(np.maximum(d - far, near - d), 0)


class Met:
    """Queries and how many pairs of theirs were multiplied."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: float | None, own: bool, measure: str):
        self.ids, self.queries, self.own = ids, queries, own
        self.score, self.bound = MEASURES[measure]
        self.threshold = np.full(len(ids), -np.inf if least is None else least)
        self.squares = (queries * queries).sum(axis=1)
        self.pairs = np.zeros(len(ids), np.int64)

    def multiply(self, some: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries and of ids, and scores, of the pairs that reach the thresholds."""
        product = self.queries[some] @ vectors.T
        found = np.round(self.score(product, self.squares[some][:, None] + (vectors * vectors).sum(axis=1) - 2 * product), 6) + 0.0
        fit = (found >= self.threshold[some][:, None] - SLACK) & (self.own | (self.ids[some][:, None] != ids))
        at, place = np.nonzero(fit)
        self.pairs[some] += len(ids)
        return some[at], place, found[at, place]


class Every(Met):
    """All pairs that reach the threshold, in blocks of PAIRS at most; nothing is held."""

    def meet(self, ids: np.ndarray, vectors: np.ndarray, clusters: np.ndarray, distances: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shells, gap = _shells(clusters, distances, self.queries, centroids)
        best = self.bound(gap)
        for n, (a, b) in enumerate(shells):
            some = np.flatnonzero(best[:, n] >= self.threshold - SLACK)
            for x in range(0, len(some), max(1, PAIRS // SHELL)):
                at, place, found = self.multiply(some[x : x + max(1, PAIRS // SHELL)], ids[a:b], vectors[a:b])
                yield at, a + place, found


class Nearest(Met):
    """The k best that each of some queries has met, by score and id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: float | None, own: bool, measure: str):
        super().__init__(ids, queries, least, own, measure)
        self.k = k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]  # places of queries, ids, scores

    def settle(self) -> None:
        """Keep the k best of each query and raise the thresholds."""
        at, ids, found = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -found, at))
        at, ids, found = at[order], ids[order], found[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        last = nth == self.k - 1
        self.threshold[at[last]] = np.maximum(self.threshold[at[last]], found[last])
        self.found = [(at[nth < self.k], ids[nth < self.k], found[nth < self.k])]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, clusters: np.ndarray, distances: np.ndarray, centroids: np.ndarray) -> None:
        """Rows in order of cluster and distance: each query's likeliest shell first, then all that reach its threshold."""
        shells, gap = _shells(clusters, distances, self.queries, centroids)
        first, best = np.argmin(gap, axis=1), self.bound(gap)
        for again in (False, True):
            for n, (a, b) in enumerate(shells):
                some = np.flatnonzero((best[:, n] >= self.threshold - SLACK) & ((first == n) != again))
                if len(some):
                    at, place, found = self.multiply(some, ids[a:b], vectors[a:b])
                    self.found.append((at, ids[a:b][place], found))
                    if again and sum(len(x[0]) for x in self.found) > 4 * (self.k + SHELL) * len(self.ids):
                        self.settle()
            self.settle()


def _met(index: VectorIndex, queries: DataFrame, k: int | None, least: float | None, own: bool) -> DataFrame:
    """query_id, vec_id, score of what each task finds, and without k the other columns of vectors and queries; and a row without vec_id with
    the pairs it multiplied for the query.

    Queries go in groups of about QUERIES, which pass through the driver; a group is one pass over the rows, without a shuffle.
    """
    centroids, measure = index.centroids, index.measure  # the tasks take these, not the index
    dims = centroids.shape[1]
    of_row, of_query = (index.rows.columns[4:], [c for c in queries.columns if c not in ("query_id", "q")]) if k is None else ([], [])
    asked = stored(_points(queries, "query_id", "q", index.measure, *of_query).filter(F.size("v") == dims), "asked")
    groups = max(1, -(-asked.count() // QUERIES))
    schema = StructType([asked.schema["query_id"], index.rows.schema["vec_id"], *StructType.fromDDL("score double, pairs bigint"), *[index.rows.schema[c] for c in of_row], *[asked.schema[c] for c in of_query]])
    target = to_arrow_schema(schema)

    def of_group(g: int) -> DataFrame:
        mine = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).orderBy("query_id").collect()
        ids, points = np.array([r.query_id for r in mine], np.int64), np.array([r.v for r in mine]).reshape(-1, dims)
        beside = [pa.array([r[c] for r in mine], target.field(4 + len(of_row) + n).type) for n, c in enumerate(of_query)]

        def given(at: np.ndarray, found: np.ndarray, scored: np.ndarray, more: list[pa.Array]) -> pa.RecordBatch:
            columns = [pa.array(ids[at], target.types[0]), pa.array(found, target.types[1]), pa.array(scored), pa.nulls(len(at), pa.int64()), *more]
            return pa.RecordBatch.from_arrays(columns, schema=target)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = Every(ids, points, least, own, measure) if k is None else Nearest(ids, points, k, least, own, measure)
            for batch in batches:
                if batch.num_rows and len(ids):
                    own_ids = batch.column(0).to_numpy()
                    met = state.meet(own_ids, _matrix(batch.column(1), dims), batch.column(2).to_numpy(), batch.column(3).to_numpy(), centroids)
                    for at, place, scored in met or ():
                        yield given(at, own_ids[place], scored, [*[c.take(pa.array(place)) for c in batch.columns[4:]], *[c.take(pa.array(at)) for c in beside]])
            if k is not None:
                yield given(*state.found[0], [])
            some = np.flatnonzero(state.pairs)
            counted = [pa.array(ids[some], target.types[0]), pa.nulls(len(some), target.types[1]), pa.nulls(len(some), pa.float64()), pa.array(state.pairs[some])]
            yield pa.RecordBatch.from_arrays([*counted, *[pa.nulls(len(some), c) for c in target.types[4:]]], schema=target)

        return index.rows.select("vec_id", "v", "cluster", "distance", *of_row).mapInArrow(released(search), schema)

    return reduce(DataFrame.unionByName, [of_group(g) for g in range(groups)])


def search(index: VectorIndex, queries: DataFrame, k: int | None = 10, least: float | None = None, own: bool = False) -> DataFrame:
    """query_id, vec_id, score (and rank, with k; without, the index's and the queries' other columns): the k vectors nearest to each of a stated set of queries (query_id, q), or all, that
    score ``least`` at least; scores have six digits, ties go to the smaller vec_id. A query's own id is left out unless own.

    Ids are whole numbers. Null queries and queries of another length give no rows.
    """
    found = _met(index, queries, k, least, own).filter("vec_id IS NOT NULL").drop("pairs")
    if least is not None:
        found = found.filter(F.col("score") >= least)
    return found if k is None else top(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def pairs_multiplied(index: VectorIndex, queries: DataFrame, k: int | None = 10, least: float | None = None) -> int:
    """How many pairs of query and vector a search multiplies."""
    return _met(index, queries, k, least, False).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]

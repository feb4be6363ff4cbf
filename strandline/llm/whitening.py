"""Whitening of embeddings: leading principal components of their covariance, each scaled to variance one.

Tasks sum the centred covariance of the distinct vectors, one row of the matrix at a time. The matrix, whose size is that of the
model and not of the table, is made tridiagonal by Householder reflections; bisection on Sturm counts finds the leading
eigenvalues, inverse iteration their vectors, made orthogonal within clusters of close eigenvalues. Tasks then project all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow import at_rest
from .shared import dropped, written

#: Steps of a vector's grid per unit.
SCALE = 256
#: Eigenvalues below this share of their sum count as zero; those nearer than this share of the norm form a cluster.
ZERO, CLUSTER = 1e-12, 1e-3
#: Rows that a task multiplies at once.
ROWS = 4096


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and subdiagonal of H...H matrix H...H, and the unit vectors of the Householder reflections H in order."""
    a, mirrors = matrix.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        v[0] += np.copysign(length, v[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def leading_eigenvalues(diagonal: np.ndarray, below: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues of a symmetric tridiagonal matrix, falling, by bisection: a Sturm count tells how many lie below x."""
    radius = np.abs(np.append(below, 0)) + np.abs(np.append(0, below))
    low = np.full(count, (diagonal - radius).min())
    high = np.full(count, (diagonal + radius).max())
    squares, tiny = np.append(0, below**2), np.finfo(float).tiny * max(1.0, (below**2).max(initial=0))
    wanted = len(diagonal) - np.arange(1, count + 1)  # so many eigenvalues lie below the j-th largest
    while True:
        x = (low + high) / 2
        if np.all((x <= low) | (x >= high)):
            return x
        q, lower = np.ones(count), np.zeros(count, int)
        for d, s in zip(diagonal, squares, strict=True):
            q = d - x - s / q
            q = np.where(np.abs(q) < tiny, -tiny, q)
            lower += q < 0
        low, high = np.where(lower <= wanted, x, low), np.where(lower <= wanted, high, x)


def shifted_solve(diagonal: np.ndarray, below: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """y with (T - shift) y = right, by elimination with row exchanges; a zero pivot counts as a very small one."""
    n, least = len(diagonal), np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(below).max(initial=0), np.finfo(float).tiny)
    main, up, far, y = (diagonal - shift).tolist(), [*below.tolist(), 0.0], [0.0] * n, right.tolist()
    for i, under in enumerate(below.tolist()):
        row, following = (main[i], up[i], far[i], y[i]), (under, main[i + 1], up[i + 1], y[i + 1])
        if abs(under) > abs(main[i]):
            row, following = following, row
        main[i], up[i], far[i], y[i] = row
        main[i] = main[i] or least
        share = following[0] / main[i]
        main[i + 1], up[i + 1], y[i + 1] = following[1] - share * up[i], following[2] - share * far[i], following[3] - share * y[i]
    for i in range(n - 1, -1, -1):
        after = (up[i] * y[i + 1] if i + 1 < n else 0.0) + (far[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = (y[i] - after) / (main[i] if abs(main[i]) > least else least)
    return np.array(y)


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = np.abs(matrix).max(initial=0)
    count = min(count, len(matrix))
    if not scale or not count:
        return np.zeros(count), np.eye(len(matrix))[:, :count]
    diagonal, below, mirrors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, below, count)
    norm = max(np.abs(values).max(), np.abs(diagonal).max())
    rng, vectors, first = np.random.default_rng(1), [], 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = value - 4 * (j - first) * np.finfo(float).eps * norm  # equal eigenvalues get shifts of their own
        y = rng.normal(size=len(matrix))
        for _ in range(6):
            for other in vectors[first:] * 2:
                y = y - (other @ y) * other
            y = shifted_solve(diagonal, below, shift, y / np.linalg.norm(y))
            y /= np.abs(y).max()
        for other in vectors[first:] * 2:
            y = y - (other @ y) * other
        vectors.append(y / np.linalg.norm(y))
    found = np.stack(vectors, axis=1)
    for k in range(len(mirrors) - 1, -1, -1):
        found[k + 1 :] -= 2 * np.outer(mirrors[k], mirrors[k] @ found[k + 1 :])
    return values * scale, found / np.linalg.norm(found, axis=0)


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums; components are columns, values their eigenvalues, explained their shares of the variance.

    identity_error is the largest absolute entry of the whitened vectors' covariance less the identity.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) squared over the dimensions, exact; None where a long cannot hold it."""
        most = max(self.n * int(np.abs(x).max(initial=0)) + abs(s) for s in self.sums)
        kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
        apart = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [d if d < 1 << 63 else None for d in (apart * apart).sum(axis=1).tolist()]


def gridded(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each component, as longs; null if the vector or a component is null, not finite or beyond a long."""
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    held = F.coalesce(F.forall(scaled, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 2.0**62), F.lit(False))), F.lit(False))
    return F.when(held, F.transform(scaled, lambda c: F.floor(c)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _mapped(df: DataFrame, apply, schema: str) -> DataFrame:
    """mapInArrow where apply gives lists of columns."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in apply(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(at_rest(run), schema)


def _summed_rows(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the rows (arrays of doubles) of each i: one row for each i, in the size of the model."""
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).select("i", F.col("row.v").alias("row"))
    return {r.i: np.asarray(r.row) for r in rows.collect()}


def fit(vectors: DataFrame, dims: int, components: int = 4) -> Whitening:
    """The whitening of a table of distinct vectors x of dims longs; components whose variance is zero are left out."""
    table = vectors.select("x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        totals, n = [0] * dims, 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            kind = np.int64 if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else object
            totals = [t + s for t, s in zip(totals, x.sum(axis=0, dtype=kind).tolist(), strict=True)]
            n += len(x)
        yield [list(range(dims)), [n] * dims, [str(t) for t in totals]]

    found = _mapped(table, sums, "i int, n long, total string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by_dim = sorted(found.collect())  # one row a dimension
    n, totals = (by_dim[0].n if by_dim else 0), tuple(int(r.total) for r in by_dim)
    if not n:
        return Whitening(0, (), np.zeros((dims, 0)), np.zeros(0), np.zeros(0))
    mean = np.array([s / n for s in totals])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                centred = _matrix(batch.column(0).slice(at, ROWS), dims) - mean
                total += centred.T @ centred
        if total.any():
            yield [list(range(dims)), total.tolist()]

    rows = _summed_rows(_mapped(table, products, "i int, row array<double>"))
    covariance = np.stack([rows.get(i, np.zeros(dims)) for i in range(dims)]) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, columns = leading_components(covariance, components)
    kept = values > ZERO * trace
    model = Whitening(n, totals, columns[:, kept], values[kept], values[kept] / (trace or 1.0))
    size = int(kept.sum())

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = model.whitened(_matrix(batch.column(0).slice(at, ROWS), dims))
                total += w.T @ np.column_stack([w, np.ones(len(w))])
        if total.any():
            yield [list(range(size)), total.tolist()]

    if not size:
        return model
    rows = _summed_rows(_mapped(table, moments, "i int, row array<double>"))
    moment = np.stack([rows[i] for i in range(size)]) / n
    spread = moment[:, :size] - np.outer(moment[:, size], moment[:, size])
    return Whitening(model.n, model.sums, model.components, model.values, model.explained, float(np.abs(spread - np.eye(size)).max()))


def whiten(vectors: DataFrame, components: int = 4, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Components c become x = floor(scale * c). The fit is over the distinct x vectors, each once, however often it occurs. Vectors that
    are null, or hold a component that is null, not finite or too large for a long, take no part; of vectors of different lengths the
    most frequent length does (the longer of equally many). Components of zero variance are left out, so vectors that are all
    alike, and empty tables, give no rows. Rows that repeat an id, or have none, each give their rows. deviation is null
    where a long cannot hold it. Other columns are not read.

    Tasks hold a matrix of dims by dims numbers; it alone reaches the driver.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), gridded(F.col(vector_col), scale).alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    main = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = main.d if main else 1
    rows = rows.filter(F.size("x") == dims)
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, dims, components)
    dropped(distinct)
    size = len(model.values)
    schema = StructType([rows.schema["vec_id"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    target = to_arrow_schema(schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if size else 0, ROWS):
                some = batch.slice(at, ROWS)
                x = _matrix(some.column(1), dims)
                deviation = np.repeat(np.array(model.deviations(x), object), size).tolist()
                columns = [np.tile(np.arange(1, size + 1), len(x)), [model.n] * (size * len(x)), deviation, model.whitened(x).ravel(), np.tile(model.explained, len(x)), [model.identity_error] * (size * len(x))]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(target)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.repeat(np.arange(len(x)), size))), *arrays], schema=target)

    return rows.mapInArrow(at_rest(project), schema)

"""Embedding whitening: distributed centred covariance, eigenvectors on the driver, broadcast projection.

Entries become whole numbers x = floor(64 * c) + 1000000. One pass gives the number of vectors n and the exact sums S, a second
the covariance V of n * x - S over n: a whole number in every entry, so centring loses nothing, and the rows are centred before
they are multiplied. Each task adds up its rows' products and hands over one triangle of d * (d + 1) / 2 numbers, which Spark
adds; the driver receives one triangle, whatever the number of rows. There V, d by d, is made tridiagonal by Householder reflections, its leading
eigenvalues are found by bisection on Sturm counts, and its eigenvectors by inverse iteration, with vectors of close
eigenvalues made orthogonal to each other. d by k numbers are broadcast for the projection.

A vector is left out if it is null, holds a null or a non-finite entry, or if its length isn't the commonest length (the
longer one of two equally common), as it has no place in that space. Empty vectors, and tables without a vector, give no
rows. A component whose eigenvalue is no more than rounding error (constant or dependent dimensions, a single vector) can't be
scaled to one and isn't returned. Rows that repeat a vec_id, or have none, are vectors like any other. An entry that is too large
for a long number, or a deviation that is, is an error. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Numbers of float64 that a task multiplies at a time.
_ROWS = 4096
_SUMS = "i int, j int, s double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that count, as whole numbers."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    sound = vectors.select("vec_id", c.alias("c")).where(
        F.col("c").isNotNull() & ~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    sound = sound.withColumn("n", F.size("c"))
    usual = sound.where("n > 0").groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = usual[0].n if usual else -1
    entry = lambda v: F.when(F.abs(v) < 2.0 ** 50, F.floor(v * SCALE)).otherwise(
        F.raise_error(F.lit("an embedding entry is too large for whole numbers")).cast("long")) + F.lit(SHIFT)
    return sound.where(F.col("n") == size).select("vec_id", F.transform("c", entry).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The x column as rows of int64."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(vectors: DataFrame, rows_of) -> DataFrame:
    """(i, j, s): the sums over all rows of the products of columns i <= j of ``rows_of(x)``; i = -1 holds the plain sums."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = sums = None
        for batch in batches:
            x = _matrix(batch) if batch.num_rows else None
            for at in range(0, batch.num_rows, _ROWS):
                y = rows_of(x[at:at + _ROWS])
                if products is None:
                    products, sums = np.zeros((y.shape[1], y.shape[1])), np.zeros(y.shape[1])
                products += y.T @ y
                sums += y.sum(axis=0)
        if products is not None:
            i, j = np.triu_indices(len(sums))
            k = np.arange(len(sums))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([i, np.full(len(k), -1)]).astype(np.int32)), pa.array(np.concatenate([j, k]).astype(np.int32)),
                pa.array(np.concatenate([products[i, j], sums]))], ["i", "j", "s"])

    return vectors.select("x").mapInArrow(of, _SUMS).groupBy("i", "j").agg(F.sum("s").alias("s"))


def _covariance(vectors: DataFrame, rows_of, size: int, n: int) -> np.ndarray:
    """Covariance over n rows; the sums left after centring are rounding error and are taken off as well."""
    products, sums = np.zeros((size, size)), np.zeros(size)
    for r in _summed(vectors, rows_of).collect():
        if r.i < 0:
            sums[r.j] = r.s
        else:
            products[r.i, r.j] = products[r.j, r.i] = r.s
    return products / n - np.outer(sums / n, sums / n)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflection vectors of a symmetric matrix, by Householder's method."""
    a = np.array(v, float)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        u = a[k + 1:, k].copy()
        size = np.linalg.norm(u)
        u[0] += np.copysign(size, u[0])
        length = np.linalg.norm(u)
        if length:
            u /= length
            p = a[k + 1:, k + 1:] @ u
            p -= (u @ p) * u
            a[k + 1:, k + 1:] -= 2 * (np.outer(u, p) + np.outer(p, u))
            a[k + 1, k] = -np.copysign(size, a[k + 1, k])
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each number of ``at``: the negative pivots of T - x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.max(off ** 2, initial=0.0)))
    count = np.zeros(len(at), int)
    pivot = np.ones(len(at))
    for i, a in enumerate(diagonal):
        pivot = a - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of the tridiagonal matrix, falling, each bisected until no double lies between its bounds."""
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    span = np.max(np.abs(diagonal) + reach)
    low = np.full(k, np.min(diagonal - reach) - span * 1e-15)
    high = np.full(k, np.max(diagonal + reach) + span * 1e-15)
    rank = len(diagonal) - np.arange(k)  # as many eigenvalues are at most the wanted one
    for _ in range(200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= span * 1e-17)):
            break
        under = sturm_counts(diagonal, off, middle) >= rank
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """Solves (T - value) z = b by elimination with row exchanges."""
    d = len(diagonal)
    main, upper, second = [float(a) - value for a in diagonal], [*map(float, off), 0.0], [0.0] * d
    steps = []
    for i in range(d - 1):
        below, beside, after = float(off[i]), main[i + 1], upper[i + 1]
        if abs(below) > abs(main[i]):
            factor = main[i] / below
            main[i], upper[i], second[i], spare = below, beside, after, upper[i]
            main[i + 1], upper[i + 1] = spare - factor * beside, -factor * after
            steps.append((True, factor))
        else:
            factor = below / (main[i] or least)
            main[i] = main[i] or least
            main[i + 1] = beside - factor * upper[i]
            steps.append((False, factor))
    main = [m if abs(m) > least else least for m in main]

    def solve(b: np.ndarray) -> np.ndarray:
        z = b.tolist()
        for i, (swapped, factor) in enumerate(steps):
            if swapped:
                z[i], z[i + 1] = z[i + 1], z[i] - factor * z[i + 1]
            else:
                z[i + 1] -= factor * z[i]
        for i in range(d - 1, -1, -1):
            rest = upper[i] * z[i + 1] if i + 1 < d else 0.0
            rest += second[i] * z[i + 2] if i + 2 < d else 0.0
            z[i] = (z[i] - rest) / main[i]
        return np.array(z)

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, close: float = 1e-3) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those within ``close`` of the norm of one another are a cluster."""
    eps = np.finfo(float).eps
    norm = max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(off), initial=0.0)), np.finfo(float).tiny)
    rng = np.random.default_rng(7)
    found = np.empty((len(diagonal), len(values)))
    start, last = 0, None
    for i, value in enumerate(values):
        if i and values[i - 1] - value > close * norm:
            start = i
        # Equal eigenvalues are shifted apart a little, so that their systems differ.
        shift = value if last is None or last - value > 10 * eps * norm else last - 10 * eps * norm
        last = shift
        solve = _solver(diagonal, off, shift, eps * norm)
        z = rng.standard_normal(len(diagonal))
        for _ in range(5):
            z = solve(z / np.linalg.norm(z))
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= found[:, start:i] @ (found[:, start:i].T @ z)
            z /= np.linalg.norm(z)
        found[:, i] = z
    return found


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their unit eigenvectors as columns; without those at rounding error."""
    diagonal, off, mirrors = tridiagonal(v)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > len(v) * np.finfo(float).eps * np.trace(v)]
    vectors = eigenvectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        u = mirrors[at]
        vectors[at + 1:] -= 2 * np.outer(u, u @ vectors[at + 1:])
    return values, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Whitening:
    """What every task needs: ``axes`` has an eigenvector over the root of its eigenvalue in each column."""

    n: int
    sums: np.ndarray  # int64
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in whole numbers."""
        if len(x) and max(abs(int(x.min())), abs(int(x.max()))) * self.n >= 1 << 62:
            raise OverflowError("n * x does not fit a long number")
        return self.n * x - self.sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of squares of n * x - S, exact."""
        y = self.centred(x)
        if len(y) and float(np.max(np.sum(y.astype(float) ** 2, axis=1))) >= 2.0 ** 63 * (1 - 1e-9):
            raise OverflowError("a deviation does not fit a long number")
        return np.sum(y * y, axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.axes


def fitted(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Whitening of all vectors of a (vec_id, x) table; None without vectors."""
    sums = vectors.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not sums:
        return None
    model = Whitening(sums[0].n, np.array([r.s for r in sums], np.int64), np.empty(0), np.empty((len(sums), 0)), 0.0)
    v = _covariance(vectors, lambda x: model.centred(x) / model.n, len(sums), model.n)
    values, axes = leading_components(v, k)
    return Whitening(model.n, model.sums, values, axes / np.sqrt(values), float(np.trace(v)))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_vectors(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: its place on the component, and what the component explains.

    ``identity_error`` is measured on the whitened vectors themselves, in a pass of its own.
    """
    spark = vectors.sparkSession
    whole = keep(whole_vectors(vectors), "vectors")
    model = fitted(whole, k)
    if model is None or not len(model.values):
        return spark.createDataFrame([], _OUT)
    sent = spark.sparkContext.broadcast(model)
    size = len(model.values)
    error = float(np.max(np.abs(_covariance(whole, lambda x: sent.value.whitened(x), size, model.n) - np.eye(size))))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part)
                rows = len(x) * size
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), size))),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, m.n, np.int64)),
                    pa.array(np.repeat(m.deviations(x), size)), pa.array(m.whitened(x).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(rows, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(of, _OUT)

"""Whitening of embeddings from a compensated covariance.

Sums of vectors and of centred outer products are kept as double-double numbers: products are split
into themselves and their error (Veltkamp and Dekker), sums into themselves and theirs (Knuth), so
nothing is lost to a mean that is large against the spread, or to many rows.  Each task sums its rows,
tasks' high and low parts are merged in rounds of ``WIDE`` and ``FEW`` tasks, where there are more - a partial sum
has the size of the matrix, whatever the number of rows - and only those few meet in the driver, which solves
the d x d matrix: LAPACK's syevd reduces it to tridiagonal form and solves that by divide and conquer.

The mean is a double-double number too, and rows are centred before they are multiplied.

Odd rows: vectors that are null, empty or hold null or non-finite entries take no part, nor do those of
another length than most have (ties: the larger length).  Repeated rows and null ids are rows like any
other.  A component without variance (below 1e-13 of the largest) has null values and no part in the error.
No rows give no rows.  Entries beyond 2^52 in ``integers`` count as that bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import arrow_batches, written

#: Rows whose products are summed at once; tasks of the two rounds in which partial sums are merged.
BLOCK, WIDE, FEW = 256, 64, 8
#: Eigenvalues below this share of the largest count as none.
FLAT = 1e-13

PART = "n long, high binary, low binary"


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a):
    t = 134217729.0 * a
    high = t - (t - a)
    return high, a - high


def add(a, b):
    """The sum of two double-double numbers (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = _fast(s, e + t)
    return _fast(s, e + f)


def _fast(a, b):
    s = a + b
    return s, b - (s - a)


def total(high: np.ndarray, low: np.ndarray):
    """The double-double sum over the first axis, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        odd = (high[2 * half :], low[2 * half :])
        high, low = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        if len(odd[0]):
            high, low = np.concatenate([high, odd[0]]), np.concatenate([low, odd[1]])
    return high[0], low[0]


def outer(high: np.ndarray, low: np.ndarray):
    """The sum over rows of the products of all pairs of columns i <= j, row by row of the triangle."""
    a, b = split(high)
    out = []
    for i in range(high.shape[1]):
        p = high[:, i : i + 1] * high[:, i:]
        e = ((a[:, i : i + 1] * a[:, i:] - p) + a[:, i : i + 1] * b[:, i:] + b[:, i : i + 1] * a[:, i:]) + b[:, i : i + 1] * b[:, i:]
        out.append(total(p, e + (high[:, i : i + 1] * low[:, i:] + low[:, i : i + 1] * high[:, i:])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def centred(x: np.ndarray, mean):
    s, e = two_sum(x, -mean[0])
    return _fast(s, e - mean[1])


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _part(n: int, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], ["n", "high", "low"])


def _sums(of: Callable, make: Callable | None = None):
    """Per task the number of vectors and the double-double sum of ``of(rows)`` over blocks of them."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, held = 0, None
        for batch in batches:
            rows = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 0))
            if make:
                rows = make(rows) if len(rows) else rows
            for at in range(0, len(rows), BLOCK):
                new = of(rows[at : at + BLOCK])
                held, n = add(held, new) if held else new, n + len(rows[at : at + BLOCK])
        if held:
            yield _part(n, held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]):
    n, held = 0, None
    for batch in batches:
        for m, high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = np.frombuffer(high), np.frombuffer(low)
            held, n = add(held, new) if held else new, n + m
    if held:
        yield _part(n, held)


def _reduced(vectors: DataFrame, run) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """(n, (high, low)) over all rows of ``vectors``, a table of one column."""
    parts, held_by = vectors.mapInArrow(run, PART), vectors.rdd.getNumPartitions()
    for tasks in (WIDE, FEW):
        if held_by > tasks:  # each has one sum at most
            parts, held_by = parts.repartition(tasks).mapInArrow(_merge, PART), tasks
    n, held = 0, None
    for r in parts.collect():  # at most FEW rows of the matrix's size
        new = np.frombuffer(r["high"]), np.frombuffer(r["low"])
        held, n = add(held, new) if held else new, n + r["n"]
    return n, held


@dataclass
class Whitening:
    """n, the exact mean, eigenvalues in falling order, components as columns, and the trace of the covariance."""

    n: int
    sums: list[Fraction]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        exact = [s / self.n for s in self.sums]
        high = np.array([float(x) for x in exact])
        return high, np.array([float(x - Fraction(h)) for x, h in zip(exact, high.tolist(), strict=True)])

    def varied(self, k: int) -> np.ndarray:
        """Which of the first k components have variance."""
        own = self.values[:k]
        return own > FLAT * max(self.values[0], 0.0) if len(own) else np.zeros(0, bool)

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """The rows of x on the first k components, each of unit variance; nan on those without variance."""
        has = self.varied(k)
        high, low = centred(x, self.mean)
        root = np.sqrt(np.where(has, self.values[:k], 1.0))
        out = (high @ self.components[:, :k] + low @ self.components[:, :k]) / root
        out[:, ~has] = np.nan
        return out


def square(n: int, d: int, sums) -> np.ndarray:
    """The covariance, divisor n, from the sums over the triangle."""
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = (sums[0] + sums[1]) / n
    return out + np.triu(out, 1).T


def covariance(vectors: DataFrame, mean, d: int, make: Callable | None = None) -> tuple[int, np.ndarray]:
    """n and the covariance of a table of one column of vectors of length d (after ``make``, if given) about ``mean``."""
    n, sums = _reduced(vectors, _sums(lambda rows: outer(*centred(rows, mean)), make))
    return n, square(n, d, sums)


def finite(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    each = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & each, F.lit(False))


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the finite vectors, as doubles, of the length that most of them have."""
    own = rows.where(finite(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    most = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own.where(F.size("x") == (most["d"] if most else 0))


def fit(vectors: DataFrame) -> Whitening | None:
    """The components of the table's column ``x``, whose vectors have one length; None without rows."""
    own = vectors.select("x")
    arrow_batches(own.sparkSession, 2000)
    n, sums = _reduced(own, _sums(lambda rows: total(rows, np.zeros_like(rows))))
    if not n:
        return None
    exact = [Fraction(h) + Fraction(l) for h, l in zip(*(s.tolist() for s in sums), strict=True)]
    held = Whitening(n, exact, np.zeros(0), np.zeros((0, 0)), 0.0)
    _, matrix = covariance(own, held.mean, len(exact))
    values, components = np.linalg.eigh(matrix)
    return Whitening(n, exact, values[::-1], components[:, ::-1], float(np.trace(matrix)))


def identity_error(model: Whitening, vectors: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    has = model.varied(k)
    d = int(has.sum())
    if not d:
        return 0.0
    make = lambda x: model.whitened(x, len(has))[:, has]
    n, sums = _reduced(vectors.select("x"), _sums(lambda rows: total(rows, np.zeros_like(rows)), make))
    mean = (sums[0] + sums[1]) / n
    return float(np.abs(covariance(vectors.select("x"), (mean, np.zeros_like(mean)), d, make)[1] - np.eye(d)).max())


def integers(vector: Column) -> Column:
    """Entries as whole numbers in 1024ths, shifted by 100000."""
    bound = float(2**52)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(1024 * c, F.lit(bound)), F.lit(-bound))) + 100000).cast("array<double>")


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For rows of whole numbers the sum of (n * x - S)^2, exactly."""
    most = max([int(np.abs(x).max()) * n, *map(abs, sums)])
    if most < 2**62:
        y = x.astype(np.int64) * n - np.array(sums, np.int64)
        if (y.astype(np.float64) ** 2).sum(1).max() < 2.0**62:
            return (y * y).sum(1).tolist()
        return [sum(v * v for v in row) for row in y.tolist()]
    return [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def _apply(model: Whitening, k: int, error: float):
    sums, has = [int(s) for s in model.sums], model.varied(k)
    k = len(has)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rows = len(x)
            exact = _deviation(x, model.n, sums)
            value = pa.array(model.whitened(x, k).reshape(-1), pa.float64(), from_pandas=True)
            share = np.where(has, model.values[:k] / (model.trace or 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, model.n), pa.int64()),
                 pa.array([v if v < 2**63 else None for v in exact for _ in range(k)], pa.int64()), value, pa.array(np.tile(share, rows), pa.float64()), pa.array(np.full(rows * k, error), pa.float64()),
                 pa.array([str(v) for v in exact for _ in range(k)], pa.string())],
                [c.split()[0] for c in WHITENED.split(", ")],
            )

    return run


def report(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """A row for each usable vector and component: its whole-number deviation and whitened value, and the model's figures.

    ``deviation`` is null beyond the range of a long; ``deviation_exact`` has it in decimals at any size.
    """
    spark = embeddings.sparkSession
    vectors = written(usable(embeddings).withColumn("x", integers(F.col("x"))))
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], WHITENED)
    arrow_batches(spark, 2000)
    return vectors.mapInArrow(_apply(model, components, identity_error(model, vectors, components)), WHITENED)

"""Whitening of embeddings: streamed covariance, merged over partitions, and a symmetric QR eigen-solve.

Each partition keeps a count, a mean and a matrix of centred products, updated by one vector at a time (Welford: the
matrix grows by a rank-one term). Partitions send one row each; the parallel update formula merges them ``FAN`` at a time
in tasks until one is left, so the driver reads a single row of d * d numbers, whatever the number of partitions. The
driver brings the covariance to tridiagonal form by reflections and to its eigenvalues by implicit QR steps.

Entries become whole numbers, x = floor(64 c) + 1000000, so their sums and each vector's deviation are exact; the
moments are taken of x - 1000000, a shift that floats hold exactly.

Defined cases: a null vector, one without entries, or one with a null, NaN or infinite entry is dropped; vectors of
different lengths are an error, and so are entries or deviations beyond 64 bits; a null id is kept; repeated rows count
and return as often as they occur; equal eigenvalues take any basis of their space, the same for all rows; components without
variance (eigenvalues within rounding of 0: constant dimensions, fewer vectors than dimensions) cannot be scaled
to 1 and are left out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, scratch, written

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Partial moments merged by one task.
FAN = 16
_MOMENTS = "part long, n long, sums binary, mean binary, spread binary"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their floor(64 c) as rows of a matrix."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN; null lists have none
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ok = lengths > 0
    ok[owner[~np.isfinite(flat)]] = False
    sizes = np.unique(lengths[ok])
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes.tolist()} entries in one table")
    x = np.floor(SCALE * flat[ok[owner]])
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise OverflowError("an entry does not fit in 64 bits")
    return ok, x.astype(np.int64).reshape(int(ok.sum()), int(sizes[0]) if len(sizes) else 0)


class Moments:
    """Count, exact sums (of whole numbers), mean and centred products of the rows that were added."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean, self.spread = 0, [0] * d, np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, row by row; whole numbers are summed as such too."""
        if rows.dtype.kind == "i":
            if len(rows) and int(np.abs(rows).max()) * len(rows) >= 1 << 62:
                raise OverflowError("a sum does not fit in 64 bits")
            self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(axis=0), strict=True)]
        term, mean, spread = np.empty_like(self.spread), self.mean, self.spread
        for row in rows.astype(np.float64):
            delta = row - mean
            np.multiply(delta[:, None], delta * (self.n / (self.n + 1)), out=term)
            self.n += 1
            mean += delta / self.n
            spread += term

    def merge(self, other: Moments) -> None:
        """The parallel update: both means, and the product of their distance."""
        if not other.n:
            return
        if self.n and len(self.mean) != len(other.mean):
            raise ValueError(f"vectors of {len(self.mean)} and {len(other.mean)} entries in one table")
        if not self.n:
            self.n, self.sums, self.mean, self.spread = other.n, other.sums, other.mean.copy(), other.spread.copy()
            return
        n, delta = self.n + other.n, other.mean - self.mean
        self.spread += other.spread + np.outer(delta, delta) * (self.n / n * other.n)
        self.mean += delta * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def row(self, part: int) -> pa.RecordBatch:
        if any(not -(1 << 63) <= s < 1 << 63 for s in self.sums):
            raise OverflowError("a sum does not fit in 64 bits")
        data = [np.array(v, k).tobytes() for v, k in ((self.sums, "<i8"), (self.mean, "<f8"), (self.spread, "<f8"))]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([self.n]), *(pa.array([d], pa.binary()) for d in data)], names=["part", "n", "sums", "mean", "spread"])

    @classmethod
    def read(cls, n: int, sums: bytes, mean: bytes, spread: bytes) -> Moments:
        d = len(mean) // 8
        out = cls(d)
        out.n, out.sums, out.mean = n, np.frombuffer(sums, "<i8").tolist(), np.frombuffer(mean, "<f8").copy()
        out.spread = np.frombuffer(spread, "<f8").reshape(d, d).copy()
        return out


def moments(vectors: DataFrame, map_rows: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments | None:
    """The moments of all remaining vectors (or of ``map_rows`` of them); None where none remain."""
    prepare(vectors.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            _, x = whole_numbers(batch.column(0))
            if len(x):
                x = map_rows(x) if map_rows else x
                held = held or Moments(x.shape[1])
                if held.mean.shape[0] != x.shape[1]:
                    raise ValueError(f"vectors of {held.mean.shape[0]} and {x.shape[1]} entries in one table")
                held.add(x)
        if held:
            yield held.row(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        held = Moments(0)
        for r in zip(*(table.column(c) for c in ("n", "sums", "mean", "spread")), strict=True):
            held.merge(Moments.read(*(v.as_py() for v in r)))
        return pa.Table.from_batches([held.row(table.column("part")[0].as_py() // FAN)])

    with scratch(vectors.sparkSession, keep=()):
        parts = written(vectors.select("embedding").mapInArrow(gather, _MOMENTS), "moments")
        last = parts.agg(F.max("part").alias("part")).first()["part"]
        if last is None:
            return None
        while last or parts.count() > 1:  # each turn leaves a FAN-th of the rows
            parts = written(parts.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(merge, _MOMENTS), "moments")
            last //= FAN
        r = parts.first()  # one row
        return Moments.read(r["n"], r["sums"], r["mean"], r["spread"])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the orthogonal q of a symmetric a = q t q', by Householder reflections."""
    a, d = a.copy(), len(a)
    q, nothing = np.eye(d), np.finfo(float).eps ** 2 * np.abs(a).max()
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size <= nothing:
            a[k + 1 :, k] = 0.0
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        p = 2 * (a[k + 1 :, k + 1 :] @ x)
        w = p - (x @ p) * x
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, their largest entry positive.

    Implicit QR steps with Wilkinson's shift chase a bulge down the tridiagonal form until a subdiagonal entry is nothing
    beside its neighbours; each step rotates two columns of q at a time.
    """
    diag, sub, q = tridiagonal(a)
    eps, hi, steps = np.finfo(float).eps, len(diag) - 1, 0
    least = eps * np.abs(a).max()  # below eps times this an entry is nothing beside any other
    while hi > 0:
        small = eps * np.maximum(np.abs(diag[:-1]) + np.abs(diag[1:]), least)
        sub[np.abs(sub) <= small] = 0.0
        if sub[hi - 1] == 0:
            hi, steps = hi - 1, 0
            continue
        lo = hi - 1
        while lo > 0 and sub[lo - 1] != 0:
            lo -= 1
        steps += 1
        if steps > most_steps:
            raise ArithmeticError("the eigen-solve did not converge")
        half = (diag[hi - 1] - diag[hi]) / 2
        shift = diag[hi] - sub[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, sub[hi - 1]), half))
        x, z = diag[lo] - shift, sub[lo]
        for k in range(lo, hi):
            size = np.hypot(x, z)
            c, s = (x / size, z / size) if size else (1.0, 0.0)
            if k > lo:
                sub[k - 1] = size
            p, r, b = diag[k], diag[k + 1], sub[k]
            diag[k] = c * c * p + 2 * c * s * b + s * s * r
            diag[k + 1] = s * s * p - 2 * c * s * b + c * c * r
            sub[k] = c * s * (r - p) + (c * c - s * s) * b
            if k + 1 < hi:
                x, z = sub[k], s * sub[k + 1]
                sub[k + 1] *= c
            q[:, [k, k + 1]] = np.stack([c * q[:, k] + s * q[:, k + 1], c * q[:, k + 1] - s * q[:, k]], axis=1)
    order = np.argsort(-diag, kind="stable")
    values, vectors = diag[order], q[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * signs


class Whitener:
    """Exact mean, and the projections that whiten: d * most numbers."""

    def __init__(self, found: Moments, most: int):
        covariance = found.spread / found.n
        values, vectors = symmetric_qr((covariance + covariance.T) / 2)
        least = max(values[0], 0.0) * len(values) * np.finfo(float).eps * 16
        k = int(min(most, (values > least).sum()))
        self.n, self.sums = found.n, np.array(found.sums, np.int64)
        self.project = vectors[:, :k] / np.sqrt(values[:k])
        self.explained = values[:k] / max(np.trace(covariance), np.finfo(float).tiny)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S of every entry, exact."""
        if len(x) and int(np.abs(x).max()) * self.n + int(np.abs(self.sums).max()) >= 1 << 63:
            raise OverflowError("n x - S does not fit in 64 bits")
        return self.n * x - self.sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x) / self.n @ self.project

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum of squares of n x - S, exact."""
        apart = self.apart(x)
        if len(x) and int(np.abs(apart).max()) ** 2 * apart.shape[1] >= 1 << 63:
            return np.array([sum(v * v for v in row) for row in apart.tolist()], object).astype(np.int64)  # raises beyond 64 bits
        return (apart * apart).sum(axis=1)


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each remaining vector of ``vectors`` (vec_id, embedding) and component.

    ``identity_error`` is measured: the whitened rows are read again, and their covariance is taken like the first.
    """
    spark = vectors.sparkSession
    found = moments(vectors)
    model = Whitener(found, most) if found else None
    if model is None or not model.project.shape[1]:
        return spark.createDataFrame([], _OUT)
    again = moments(vectors, model.whiten)
    k = model.project.shape[1]
    error = float(np.abs(again.spread / again.n - np.eye(k)).max())
    numbers = np.arange(1, k + 1, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = whole_numbers(batch.column(1))
            rows = len(x)
            ids = batch.column(0).filter(pa.array(ok)).take(pa.array(np.repeat(np.arange(rows), k)))
            columns = [np.tile(numbers, rows), np.full(rows * k, model.n), np.repeat(model.deviations(x), k) if rows else np.zeros(0, np.int64), (model.whiten(x) if rows else np.zeros(0)).ravel(), np.tile(model.explained, rows), np.full(rows * k, error)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, _OUT)

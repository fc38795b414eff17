"""Embedding whitening by a randomised range finder.

Vectors become whole numbers, so sums and means are exact. The covariance is met only through its
product with a thin block of columns: each pass sends the block to all tasks, which add up
centred row times (centred row times block) over their rows, and the partial sums are added in two
steps. A block of random columns, some more than the components wanted, goes through a few passes
with orthonormal columns in between (the range finder with power passes). Rayleigh-Ritz then gives
eigenpairs within the block's range, and their residuals, from one more pass. Where a residual is
too large (flat spectra), the block grows to the full dimension, whose range is everything, and
Rayleigh-Ritz is exact. All passes read all rows; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stash

COMPONENTS = 32
#: Columns of the block beyond the components wanted, and passes after the first.
OVERSAMPLING, POWER_PASSES = 8, 3
#: The largest residual of a component, as a part of its own eigenvalue, with which the block does.
RESIDUAL = 1e-12
#: Eigenvalues below this part of the trace count as zero: their components are not whitened.
NOTHING = 1e-13
#: Partial sums that reach the driver.
PARTS = 16
#: Scale and offset of the whole numbers.
SCALE, OFFSET = 64, 1_000_000
_MOST = 1 << 62


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (longs): rows with a vector of finite components, of the commonest length (the lesser of equally common ones)."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(_MOST)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(fits)
    rows = stash(rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * SCALE) + OFFSET).alias("x")), "whole")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """The sum over all rows of ``part`` of a block of them; None without rows. Tasks add up theirs, some tasks those, the driver ``PARTS``."""

    def own(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                for k in range(0, len(x), 4096):
                    more = part(x[k : k + 4096])
                    total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part"])

    def several(batches):
        parts = [np.frombuffer(p.as_py(), kind) for batch in batches for p in batch.column(0)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(parts[1:], parts[0]).tobytes()], pa.binary())], names=["part"])

    parts = rows.select("x").mapInArrow(own, "part binary").repartition(PARTS).mapInArrow(several, "part binary")
    got = [np.frombuffer(bytes(r["part"]), kind) for r in parts.collect()]  # at most PARTS rows of one block
    return sum(got[1:], got[0]) if got else None


@dataclass
class Whitening:
    """What was fitted: ``n`` rows of sums ``total``; ``axes`` (d x components), ``eigenvalues``, and the trace of the covariance."""

    n: int
    total: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace else np.zeros(len(self.eigenvalues))

    @property
    def real(self) -> np.ndarray:
        return self.eigenvalues > NOTHING * self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.divide(1, np.sqrt(self.eigenvalues), out=np.full(len(self.eigenvalues), np.nan), where=self.real)
        return self.centred(x) @ (self.axes * scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        far = max((max(abs(int(x[:, k].max()) * self.n - s), abs(int(x[:, k].min()) * self.n - s)) for k, s in enumerate(self.total)), default=0)
        if far < 1 << 62 and far**2 * len(self.total) < 1 << 63 and all(abs(s) < 1 << 62 for s in self.total):
            d = x * np.int64(self.n) - np.array(self.total, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.total, dtype=object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n, where whole parts are taken off as whole numbers first."""
    parts = [divmod(s, n) for s in total]
    return (x - np.array([q for q, _ in parts], dtype=np.int64)) - np.array([r / n for _, r in parts])


def orthonormal(block: np.ndarray) -> np.ndarray:
    """An orthonormal basis that holds the block's range (twice, against cancellation)."""
    return np.linalg.qr(np.linalg.qr(block)[0])[0]


def fit(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = POWER_PASSES, residual: float = RESIDUAL) -> Whitening | None:
    """The leading eigenpairs of the covariance of ``rows`` (x); None without rows."""
    # Halves of 31 bits are summed apart, so no sum leaves a long.
    sums = added(rows, lambda x: np.concatenate([[len(x)], (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)]), np.int64)
    if sums is None:
        return None
    n, d = int(sums[0]), (len(sums) - 1) // 2
    total = [(int(a) << 31) + int(b) for a, b in zip(sums[1 : d + 1], sums[d + 1 :], strict=True)]

    def times(block: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times the block, and its trace."""

        def part(x):
            c = centred(x, n, total)
            return np.append((c.T @ (c @ block)).ravel(), (c * c).sum())

        got = added(rows, part, np.float64) / n
        return got[:-1].reshape(block.shape), float(got[-1])

    def ritz(basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        image, trace = times(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
        axes = basis @ turn
        return np.maximum(values, 0), axes, np.linalg.norm(image @ turn - axes * values, axis=0), trace

    size = min(d, components + oversampling)
    if size < d:
        block = np.random.default_rng(11).standard_normal((d, size))
        for _ in range(1 + passes):
            block = orthonormal(times(block)[0])
        values, axes, left, trace = ritz(block)
    if size == d or (left > residual * np.maximum(values, NOTHING * trace)).any():
        values, axes, left, trace = ritz(np.eye(d))
    axes = axes / np.linalg.norm(axes, axis=0)
    model = Whitening(n, total, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1), values, trace)
    if model.real.any():
        model.identity_error = identity_error(rows, model)
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components that are whitened."""

    def part(x):
        w = model.whitened(x)[:, model.real]
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got, k = added(rows, part, np.float64) / model.n, int(model.real.sum())
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: every vector on each of the leading components.

    Rows whose vector is null, empty or holds null, non-finite or unrepresentable components (64
    times it must fit a long) take no part, nor do vectors of another length than the commonest.
    Rows without id and repeated rows count and are returned as any other. Components without
    variance have null in ``whitened`` and 0 in ``explained``; where none has any, identity_error is
    0. ``deviation`` is null where it does not fit a long. An empty table gives no row. Columns
    beyond vec_id and embedding are not read.
    """
    rows = whole(vectors)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 4096):
                some = batch.slice(k, 4096)
                x = matrix(some.column(1))
                w = model.whitened(x)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(model.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    out = rows.mapInArrow(run, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))

"""Embedding whitening by block Jacobi-Davidson.

Entries become longs x = floor(64 c) + 1000000. The covariance V of all vectors is
never formed. What the eigensolver needs of it are products with a few columns at a
time, each one pass over the table: a task centres its vectors (from the exact
integers n x - S), multiplies, and gives back a sum as small as the columns; Spark
adds these sums up.

The solver keeps a search space. Rayleigh-Ritz on it gives pairs; those whose residual
reaches double precision are locked, in order, and projected out from then on. For each
of the others the correction equation, projected against the locked vectors and its
own, is solved by a few steps of MINRES; all of them step together, so that a step is
one pass, whatever the number of components. The corrections widen the space, which
is cut back to its best part where it grows beyond ``SPACE`` blocks. At the end all
residuals are measured once more with a fresh product.

The driver holds ``dim`` x (components * (SPACE + 2)) numbers, tasks as much and a slice
of a batch; neither grows with the table.

Defined results: vectors that are null, empty, of another length than most, or hold
null or non-finite entries take no part; rows with a null vec_id and repeated rows are
rows like others; entries beyond 2^56 are taken as 2^56; components whose eigenvalue is under
``LEAST`` of the first (constant or dependent dimensions, few rows) can't be whitened
and are left out, so equal vectors alone give no rows; of equal eigenvalues any
orthonormal vectors are given; a deviation too large for its type is null; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlake.llm.common import saved

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Blocks of the search space; MINRES steps at most and the residual at which they end; rounds at most.
SPACE, STEPS, INNER, ROUNDS = 4, 8, 0.05, 200
#: Residuals relative to the largest eigenvalue; the least eigenvalue that is whitened.
PRECISION, LEAST = 64 * np.finfo(float).eps, 1e-11
SEED, SLICE = 11, 4096
_LIMIT = float(1 << 56)


def coded(vector: Column) -> Column:
    """x = floor(64 c) + 1000000 of each entry."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), c.cast("double") * SCALE))).cast("long") + SHIFT)


def usable(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(vec_id, x) of the vectors that take part, their length and number."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = saved(rows.where(v.isNotNull() & (F.size(v) > 0)).where(fine)
                 .select(F.col("vec_id").cast("long").alias("vec_id"), coded(v).alias("x"), F.size(v).alias("dim")))
    sizes = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = sizes[0] if sizes else (1, 0)
    return good.where(F.col("dim") == dim).select("vec_id", "x"), dim, n


def _slices(it: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in it:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            yield part, part.column(at).flatten().to_numpy().reshape(-1, dim)


def exact_sums(table: DataFrame, dim: int) -> list[int]:
    """The sum of each dimension, exactly: high and low halves are summed apart."""
    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for _, x in _slices(it, 0, dim):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    parts = table.select("x").mapInArrow(each, "i long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    out = [0] * dim
    for r in parts.groupBy("i").agg(*wide).collect():
        out[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


class Centre:
    """Exact sums and what follows from them."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray | None:
        """n x - S, or None where 64 bits can't hold it."""
        gap = x - self.floor
        most = max(int(gap.max()), -int(gap.min()), 1)
        return gap * self.n - self.rest if most * self.n < 1 << 62 else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = self.scaled(x)
        return whole / self.n if whole is not None else (x - self.floor).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact squared lengths of n x - S."""
        kind = pa.decimal128(38, 0)
        whole = self.scaled(x)
        if whole is not None and float(np.abs(whole).max()) ** 2 * x.shape[1] < 1 << 62:
            return pa.array((whole * whole).sum(axis=1)).cast(kind)
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return pa.array([None if v >= 10**38 else v for v in out]).cast(kind) if max(out) < 1 << 63 else pa.array(
            [None if v >= 10**38 else Decimal(v) for v in out], kind)


def summed(table: DataFrame, dim: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of what ``part`` makes of a slice of them: ``size`` numbers."""
    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _slices(it, 0, dim):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    out = np.zeros(size)
    parts = table.select("x").mapInArrow(each, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


# -- the eigensolver -----------------------------------------------------------

def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int = STEPS, enough: float = INNER) -> np.ndarray:
    """Solve for all columns of ``right`` at once, each by its own recurrence."""
    start = np.linalg.norm(right, axis=0)
    safe = lambda z: np.where(z > 0, z, 1.0)
    v, before = right / safe(start), np.zeros_like(right)
    w, w_before, x = (np.zeros_like(right) for _ in range(3))
    eta, beta = start.copy(), np.zeros_like(start)
    c, c_before, s, s_before = np.ones_like(start), np.ones_like(start), np.zeros_like(start), np.zeros_like(start)
    live = start > 0
    for _ in range(steps):
        if not live.any():
            break
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p -= alpha * v + beta * before
        grown = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_before * s * beta
        rho = np.hypot(delta, grown)
        new = (v - s_before * beta * w_before - (s * alpha + c_before * c * beta) * w) / safe(rho)
        c_before, c, s_before, s = c, delta / safe(rho), s, grown / safe(rho)
        x += np.where(live, c * eta, 0) * new
        eta = np.where(live, -s * eta, eta)
        w_before, w, before, v, beta = w, new, v, p / safe(grown), grown
        live = live & (rho > 0) & (grown > 0) & (np.abs(eta) > enough * start)
    return x


def _added(block: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the spaces."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(3):
        for s in spaces:
            block = block - s @ (s.T @ block)
        u, size, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, size > 1e-10]
    return block


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, want: int, precision: float = PRECISION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues, their vectors and their residuals (relative to the largest), of a positive matrix."""
    rng = np.random.default_rng(SEED)
    locked = np.zeros((dim, 0))
    space = np.linalg.qr(rng.standard_normal((dim, want)))[0]
    image = product(space)
    top = 0.0
    for _ in range(ROUNDS):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        top = max(top, theta[0] if len(theta) else 0.0)
        left = want - locked.shape[1]
        off = image[:, :left] - space[:, :left] * theta[:left]
        far = np.linalg.norm(off, axis=0) > precision * top
        whole = space.shape[1] + locked.shape[1] == dim  # Rayleigh-Ritz on all there is
        done = left if whole or not far.any() else int(far.argmax())
        locked, space, image = np.c_[locked, space[:, :done]], space[:, done:], image[:, done:]
        if locked.shape[1] >= want:
            break
        off, theta, far = off[:, done:], theta[done:left], far[done:]
        if space.shape[1] > SPACE * want:
            space, image = space[:, :2 * want], image[:, :2 * want]
        aim, shift = space[:, :len(theta)][:, far], theta[far]

        def projected(x: np.ndarray) -> np.ndarray:
            x = x - locked @ (locked.T @ x)
            return x - aim * (aim * x).sum(axis=0)

        fixes = minres(lambda v: projected(product(projected(v)) - shift * projected(v)), -projected(off[:, far]))
        new = _added(fixes, locked, space)
        if not new.shape[1]:
            new = _added(rng.standard_normal((dim, 1)), locked, space)
        space, image = np.c_[space, new], np.c_[image, product(new)]
    else:
        raise RuntimeError(f"{want - locked.shape[1]} of {want} pairs didn't converge in {ROUNDS} rounds")
    vectors = np.linalg.qr(locked)[0]
    image = product(vectors)
    h = vectors.T @ image
    theta, s = np.linalg.eigh((h + h.T) / 2)
    theta, vectors, image = theta[::-1], vectors @ s[:, ::-1], image @ s[:, ::-1]
    residual = np.linalg.norm(image - vectors * theta, axis=0) / max(theta[0], 1e-300)
    return theta, vectors, residual


# -- whitening -----------------------------------------------------------------

class Whitening(NamedTuple):
    """A fitted whitening: exact sums, eigenvalues and vectors, residuals, trace, and how far the result is from white."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float


def fit(table: DataFrame, dim: int, n: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all vectors of (vec_id, x); None where no component can be whitened."""
    if not n:
        return None
    centre = Centre(n, exact_sums(table, dim))
    trace = summed(table, dim, 1, lambda x: np.array([np.square(centre.centred(x)).sum()]))[0] / n
    if not trace > 0:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            own = centre.centred(x)
            return (own.T @ (own @ q)).ravel()

        return summed(table, dim, q.size, part).reshape(q.shape) / n

    values, vectors, residuals = jacobi_davidson(product, dim, min(components, dim))
    fine = values > LEAST * values[0]
    values, vectors, residuals = values[fine], vectors[:, fine], residuals[fine]
    turn, k = vectors / np.sqrt(values), len(values)
    mean = summed(table, dim, k, lambda x: (centre.centred(x) @ turn).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        white = centre.centred(x) @ turn - mean
        return (white.T @ white).ravel()

    error = np.abs(summed(table, dim, k * k, spread).reshape(k, k) / n - np.eye(k)).max()
    return Whitening(centre, values, vectors, residuals, float(trace), float(error))


def transform(table: DataFrame, dim: int, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array) of each vector of (vec_id, x)."""
    turn, centre = model.vectors / np.sqrt(model.values), model.centre

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _slices(it, 1, dim):
            if b.num_rows:
                white = centre.centred(x) @ turn
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), centre.deviations(x), pa.ListArray.from_arrays(at, pa.array(white.ravel()))],
                                                 names=["vec_id", "deviation", "whitened"])

    return table.mapInArrow(each, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: its place on the component, and what share of the variance that explains."""
    table, dim, n = usable(rows)
    model = fit(table, dim, n, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                                     "explained double, identity_error double, residual double")
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    residual = F.array(*(F.lit(float(v)) for v in model.residuals))
    out = transform(table, dim, model).select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      share[F.col("i")].alias("explained"), F.lit(model.identity_error).alias("identity_error"), residual[F.col("i")].alias("residual"))

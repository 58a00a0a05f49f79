"""Embeddings whitened by the leading components of their covariance, found by Chebyshev-filtered subspace iteration.

The covariance is never formed: each step is one distributed pass that sums, over centred rows z, zᵀ(zQ) for a thin block Q. A polynomial
in the covariance, by the three-term recurrence, damps the unwanted part of the spectrum and lifts the wanted one; QR and
Rayleigh-Ritz follow, until residuals are at rounding. A block of fresh random directions, filtered alike, then
certifies that no larger component was missed. Driver and tasks hold ``dimensions x block`` numbers, whatever the rows.

Entries are whole numbers; sums are exact, and rows are centred as whole numbers less the fraction of the mean, so an offset costs no digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Rows of a block, and the largest absolute entry that takes part: more counts as not finite.
ROWS, LARGEST = 4096, 2.0**40
#: Guard directions beside the wanted ones: half as many, GUARD at least. Most steps of a filter, and most that it may lift one direction over another.
GUARD, DEGREE, LIFT = 8, 12, 1e9
#: Residuals, over the largest eigenvalue, that certify a component; rounds after which the fit fails; components under FLAT of the largest have no spread.
CERTIFIED, ROUNDS, FLAT = 1e-12, 60, 1e-11


@dataclass
class Whitening:
    """n, exact sums S, components as columns (unit vectors, by falling eigenvalue), eigenvalues, trace, and the passes that the fit took."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def fraction(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])


def fixed_point(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of each entry, or null for a vector that is null, empty, or has an entry that is null, not finite or over LARGEST."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LARGEST))
    return F.when(~bad & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset))


def blocks_of(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vectors`` (vec_id, embedding) as a written table of blocks: dims, n, ids, and x as rows of little-endian longs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            dims = np.diff(x.offsets.to_numpy())
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                for i in range(0, len(rows), ROWS):
                    some = pa.array(rows[i : i + ROWS])
                    values = x.take(some).flatten().to_numpy().astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([batch.column("vec_id").take(some).to_pylist()], pa.list_(pa.int64())), pa.array([values])], ["dims", "n", "ids", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), fixed_point(F.col("embedding"), scale, offset).alias("x")).where("x is not null")
    return written(rows.mapInArrow(pack, "dims int, n long, ids array<long>, x binary"), "blocks")


def _summed(blocks: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum, over all blocks, of what ``part`` makes of a block's rows: ``size`` numbers from each task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("x"):
                total += part(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

    out = np.zeros(size)
    for r in blocks.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _exact_sums(blocks: DataFrame, d: int) -> list[int]:
    """Column sums as Python's whole numbers: halves of 32 bits are added apart, so none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            for x in batch.column("x"):
                total = [a + b for a, b in zip(total, np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array([t >> 32 for t in total], pa.int64()), pa.array([t & 0xFFFFFFFF for t in total], pa.int64())], ["at", "high", "low"])

    rows = blocks.select("x").mapInArrow(run, "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out = [0] * d
    for r in rows:
        out[r["at"]] = (r["high"] << 32) + r["low"]
    return out


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` in the operator, small on ``low`` to ``high``, of ``q``; scaled so that ``top`` gives about 1."""
    centre, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (product(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (product(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def _ritz(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, Ritz vectors, and their residuals' norms, of the span of ``q``."""
    q, _ = np.linalg.qr(q)
    q, _ = np.linalg.qr(q)
    w = product(q)
    h = q.T @ w
    values, u = np.linalg.eigh((h + h.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    q, w = q @ u, w @ u
    return values, q, np.linalg.norm(w - q * values, axis=0)


def _least(product: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> float:
    """A lower bound on the spectrum by Lanczos steps: the least Ritz value less the last off-diagonal, not under 0."""
    v, before, beta = rng.standard_normal((d, 1)), np.zeros((d, 1)), 0.0
    v /= np.linalg.norm(v)
    basis, alphas, betas = [v], [], []
    for _ in range(min(steps, d)):
        w = product(v) - beta * before
        alphas.append(float((v.T @ w)[0, 0]))
        w -= alphas[-1] * v
        for b in basis:
            w -= b * float((b.T @ w)[0, 0])
        beta = float(np.linalg.norm(w))
        betas.append(beta)
        if beta <= 1e-12 * abs(alphas[0]):
            break
        before, v = v, w / beta
        basis.append(v)
    t = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - betas[-1])


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and unit eigenvectors of a symmetric operator without negative eigenvalues, known by its products with d x m blocks.

    Ends when residuals are at rounding, or fails after ROUNDS. Equal eigenvalues give some basis of their space.
    """
    rng = np.random.default_rng(seed)
    m = min(d, k + max(GUARD, k // 2))
    values, q, residuals = _ritz(product, rng.standard_normal((d, m)))
    low = _least(product, d, 12, rng) if m < d else 0.0
    probed, worst = m == d, math.inf
    for _ in range(ROUNDS):
        now = float(residuals[:k].max()) / max(values[0], 1e-300)
        done = now <= CERTIFIED and now > worst / 4 or now <= 1e-15 or values[0] <= 0
        if done and probed:
            return values[:k], q[:, :k]
        high, top = float(values[-1]), float(values[0])
        lower = min(low, high * (1 - 1e-3))
        flat = high <= FLAT * top or values[k - 1] <= high
        degree = 2 if flat else _degree(lower, high, top, float(values[k - 1]))
        lift = (lambda x: product(x)) if flat else (lambda x: filtered(product, x, degree, lower, high, top))  # noqa: B023
        if done:  # fresh directions, away from the found ones: what was missed would stand out there
            extra = rng.standard_normal((d, m - k))
            extra -= q[:, :k] @ (q[:, :k].T @ extra)
            extra, _ = np.linalg.qr(extra)
            extra = lift(extra)
            extra -= q[:, :k] @ (q[:, :k].T @ extra)
            probed = bool(_ritz(product, extra)[0][0] <= values[k - 1] + 10 * CERTIFIED * top)
            if probed:
                continue
            q, worst = np.concatenate([q[:, :k], extra], axis=1), math.inf
            values, q, residuals = _ritz(product, q)
            continue
        worst = now
        values, q, residuals = _ritz(product, lift(q))
    raise ArithmeticError(f"no certified components after {ROUNDS} rounds: residual {now}")


def _degree(low: float, high: float, top: float, least: float) -> int:
    """As many steps as lift ``top`` over the damped part by LIFT at most, 2 to DEGREE."""
    reach = (top - (low + high) / 2) / ((high - low) / 2)
    return int(min(DEGREE, max(2, math.log(LIFT) // math.log(reach + math.sqrt(reach * reach - 1)))))


def fit(blocks: DataFrame, components: int = 32) -> Whitening | None:
    """Components of a written table of blocks; None if it has no rows or no spread. Vectors of another length than most have take no part (of equally
    common lengths, the longest does)."""
    first = blocks.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if first is None:
        return None
    d, n = first["dims"], first["n"]
    blocks, passes = blocks.where(F.col("dims") == d), 0
    model = Whitening(n, _exact_sums(blocks, d), np.empty((d, 0)), np.empty(0), 0.0, 0)
    base, fraction = model.base, model.fraction

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            z = (x - base) - fraction
            return z.T @ (z @ q)

        return _summed(blocks, d, q.size, part).reshape(q.shape) / n

    model.trace = float(_summed(blocks, d, d, lambda x: np.square((x - base) - fraction).sum(axis=0)).sum()) / n
    if model.trace <= 0:
        return None
    values, vectors = leading(product, d, min(components, d))
    held = values > FLAT * values[0]
    model.values, model.vectors, model.passes = values[held], vectors[:, held], passes
    return model


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, from a pass over all of them."""
    d, k = model.vectors.shape
    base, fraction, lens = model.base, model.fraction, model.vectors / np.sqrt(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = ((x - base) - fraction) @ lens
        return np.concatenate([(w.T @ w).reshape(-1), w.sum(axis=0)])

    total = _summed(blocks.where(F.col("dims") == d), d, k * k + k, part) / model.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def project(blocks: DataFrame, model: Whitening) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error. A deviation beyond a long is null."""
    d, k = model.vectors.shape
    error = identity_error(blocks, model)
    base, fraction, lens, n = model.base, model.fraction, model.vectors / np.sqrt(model.values), model.n
    rest = [s - n * b for s, b in zip(model.sums, base.tolist(), strict=True)]  # n * x - S = n * (x - base) - rest
    explained = model.values / model.trace
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def deviations(y: np.ndarray) -> pa.Array:
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * d < 2**63:
            return pa.array(np.square(n * y - np.array(rest, dtype=np.int64)).sum(axis=1))
        exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
                y = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d) - base
                w, rows = (y - fraction) @ lens, len(y)
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), deviations(y).take(each), pa.array(w.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))], names
                )

    return blocks.where(F.col("dims") == d).select("ids", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``project`` of ``vectors`` on their own ``components`` largest components (fewer where dimensions or spread are).

    Rows whose vector is null or empty, has an entry that is null, not finite or beyond LARGEST, or another length than most, are left out; the others count
    as often as they stand there, null ids too. Without rows, or where all vectors are equal, there are no components and no rows.
    Other columns are left behind.
    """
    blocks = blocks_of(vectors, scale, offset)
    model = fit(blocks, components)
    if model is None:
        return blocks.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return project(blocks, model)

"""Whitening of integer vectors by Golub-Kahan-Lanczos bidiagonalisation.

X holds the distinct vectors, centred, one per row; it stays distributed.  A step multiplies
u = X v and then v = X^T u, and makes both orthogonal to all earlier ones (full
reorthogonalisation): X V = U B with B upper bidiagonal.  The singular values of the small B are
those of X and its right vectors give the principal components.

The long vectors u are never stored: u_j = X w_j for a short w_j that the driver keeps.  So a step
is one pass: a task multiplies its rows with all w and with the new direction, and adds up the
inner products with the earlier u and the product X^T u, a few short vectors for each task.
A lost executor costs the tasks that it ran.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ship
from graphloom.storage import StageTables

LARGEST = 1 << 53


def finite(vector: str) -> Column:
    """True for vectors that are not null and hold no null or non-finite component."""
    real = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(real, F.lit(False))


def packed_integers(rows: DataFrame, vector: str, scale: float, shift: int, limit: int = LARGEST) -> DataFrame:
    """The other columns of rows with `_gl_size` (components) and `_gl_x`: floor(scale * c) + shift of
    each component c as packed 64-bit integers; integers beyond the limit are set to it."""
    kept = [f for f in rows.schema.fields if f.name != vector]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _gl_size int, _gl_x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            with np.errstate(over="ignore"):  # a product beyond double is beyond the limit
                whole = np.clip(np.floor(flat * scale) + shift, -limit, limit).astype("<i8").tobytes()
            at = ((ends - ends[0]) * 8).tolist()
            blobs = pa.array([whole[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())
            sizes = pa.array(np.diff(ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], sizes, blobs], names=[*batch.schema.names[: len(kept)], "_gl_size", "_gl_x"])

    ship(rows.sparkSession)
    source = rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{vector}`").cast("array<double>").alias(vector))
    return source.mapInArrow(run, fields)


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), size)


def _exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """x as Python integers if sums of its multiples could pass 64 bits."""
    largest = int(np.abs(x).max(initial=0)) * factor * max(1, len(x))
    return x if largest < 1 << 62 else x.astype(object)


@dataclass
class Fit:
    """The list of n vectors with sums per dimension, and what the bidiagonalisation found."""

    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray | None = None  # eigenvalues of the covariance, falling
    axes: np.ndarray | None = None  # unit components as columns
    identity_error: float = 0.0
    steps: int = 0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        bound = max(map(abs, self.sums), default=0)
        x = x if int(np.abs(x).max(initial=0)) * self.n + bound < 1 << 62 else x.astype(object)
        return x * self.n - np.array(self.sums, dtype=x.dtype)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)


def _gather(fit_rows: DataFrame, size: int, work) -> list[list]:
    """Work on the rows of every task, and its short answers: work(batches of x) -> list of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = json.dumps(work(unpacked(b.column(0), size) for b in batches if b.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array([answer])], names=["answer"])

    return [json.loads(r.answer) for r in fit_rows.mapInArrow(run, "answer string").collect()]


def _count_and_sum(rows: DataFrame, size: int) -> Fit:
    def work(batches):
        n, sums = 0, [0] * size
        for x in batches:
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, _exact(x).sum(axis=0))]
        return [n, *sums]

    found = _gather(rows, size, work)
    return Fit(sum(f[0] for f in found), [sum(f[1 + i] for f in found) for i in range(size)])


def bidiagonalise(rows: DataFrame, size: int, fit: Fit, most: int, seed: int, exact_to: int) -> None:
    """Fills in the components of a fit.

    Vectors of up to `exact_to` dimensions take a step for each dimension, so that values which
    occur several times are found as often; longer ones stop when the leading values are settled to
    double precision.  Where the steps reach an invariant subspace (beta 0) they go on from a new
    direction orthogonal to all earlier ones.  Components whose value is zero to rounding are left out.
    """
    rng = np.random.default_rng(seed)
    right = np.zeros((size, 0))  # V
    short = np.zeros((size, 0))  # W: U = X W
    back = np.zeros((size, 0))  # X^T U
    alphas: list[float] = []
    betas: list[float] = []

    def fresh() -> np.ndarray:
        v = rng.normal(size=size)
        for _ in range(3):
            v -= right @ (right.T @ v)
        return v / np.linalg.norm(v)

    def product(direction: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        earlier = short

        def work(batches):
            square, trace = 0.0, 0.0
            inner, through = np.zeros(earlier.shape[1]), np.zeros(size)
            for x in batches:
                centred = fit.centred(x)
                u = centred @ direction
                square += float(u @ u)
                inner += (centred @ earlier).T @ u
                through += centred.T @ u
                trace += float(np.square(centred).sum())
            return [square, trace, inner.tolist(), through.tolist()]

        found = _gather(rows, size, work)
        return (
            sum(f[0] for f in found),
            np.sum([f[2] for f in found], axis=0),
            np.sum([f[3] for f in found], axis=0),
            sum(f[1] for f in found),
        )

    v, beta = fresh(), 0.0
    while True:
        right = np.column_stack([right, v])
        # X (v - beta w) = X v - beta u of the step before.
        direction = v - beta * short[:, -1] if beta else v
        square, inner, through, whole = product(direction)
        fit.trace = whole / fit.n
        floor = np.sqrt(whole) * size * np.finfo(float).eps
        alpha = np.sqrt(max(0.0, square - float(inner @ inner)))
        if alpha > floor:
            w, z = (direction - short @ inner) / alpha, (through - back @ inner) / alpha
        else:
            alpha, w, z = 0.0, np.zeros(size), np.zeros(size)
        alphas.append(alpha)
        short, back = np.column_stack([short, w]), np.column_stack([back, z])
        fit.steps = len(alphas)
        rest = z - alpha * v
        for _ in range(2):
            rest = rest - right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        left, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if fit.steps == size or whole == 0:
            break
        if size > exact_to and fit.steps >= 2 * most:
            if (beta * np.abs(left[-1, :most])).max() <= 4 * np.finfo(float).eps * values[0]:
                break
        beta, v = (beta, rest / beta) if beta > floor else (0.0, fresh())
        betas.append(beta)
    kept = [i for i in range(min(most, len(values))) if values[i] > np.sqrt(whole) * size * np.finfo(float).eps]
    axes = right @ turned.T[:, kept]
    fit.axes = axes / np.linalg.norm(axes, axis=0)
    fit.values = values[kept] ** 2 / fit.n


def _identity_error(rows: DataFrame, size: int, fit: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened list minus the identity."""
    count = len(fit.values)

    def work(batches):
        total, products = np.zeros(count), np.zeros((count, count))
        for x in batches:
            y = fit.whitened(x)
            total += y.sum(axis=0)
            products += y.T @ y
        return [total.tolist(), products.tolist()]

    found = _gather(rows, size, work)
    mean = np.sum([f[0] for f in found], axis=0) / fit.n
    covariance = np.sum([f[1] for f in found], axis=0) / fit.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(count)).max(initial=0.0))


FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    most: int = 16,
    scale: float = 64.0,
    shift: int = 1_000_000,
    seed: int = 42,
    exact_to: int = 128,
) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) for up to `most` components.

    Each component c of a vector becomes x = floor(scale * c) + shift; the fit is over the distinct
    x vectors, so repeated rows and copies count once and get equal results each.  Null vectors and
    those with null or non-finite components are left out, as are other columns; null keys stay.
    Vectors of another length are fitted by themselves.  deviation: sum of (n * x - sums)^2,
    null if it does not fit a long; integers x beyond 2^53 are set to it.  A list of one distinct vector, empty vectors, and
    empty tables have no component and give no rows.
    """
    spark = vectors.sparkSession
    stage = StageTables(spark, "whiten")
    usable = vectors.where(finite(vector)).select(F.col(key).alias("_gl_key"), F.col(vector).alias("_gl_vector"))
    rows, _ = stage.put(packed_integers(usable, "_gl_vector", scale, shift), "rows")
    distinct, _ = stage.put(rows.select("_gl_size", "_gl_x").distinct(), "distinct")
    # One row per length of vector.
    sizes = sorted(r[0] for r in distinct.select("_gl_size").distinct().collect() if r[0])
    fits: dict[int, Fit] = {}
    for size in sizes:
        own = distinct.where(F.col("_gl_size") == size).select("_gl_x")
        fits[size] = fit = _count_and_sum(own, size)
        bidiagonalise(own, size, fit, most, seed, exact_to)
        fit.identity_error = _identity_error(own, size, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for size, fit in fits.items():
                picked = np.flatnonzero(widths == size)
                count = len(fit.values)
                if not len(picked) or not count:
                    continue
                part = batch.take(pa.array(picked))
                x = unpacked(part.column(2), size)
                apart = fit.deviations(x)
                exact = apart if int(np.abs(apart).max(initial=0)) ** 2 * size < 1 << 62 else apart.astype(object)
                squares = [s if s < 1 << 63 else None for s in map(int, (exact * exact).sum(axis=1))]
                again = pa.array(np.repeat(np.arange(len(picked)), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(picked))),
                        pa.array(np.full(len(again), fit.n, np.int64)),
                        pa.array(squares, pa.int64()).take(again),
                        pa.array(fit.whitened(x).ravel()),
                        pa.array(np.tile(fit.values / fit.trace, len(picked))),
                        pa.array(np.full(len(again), fit.identity_error)),
                    ],
                    names=["_gl_key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["_gl_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_gl_key {kind}, {FIELDS}").withColumnRenamed("_gl_key", key)

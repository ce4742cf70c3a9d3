"""Whitening of embeddings: the leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration over distributed passes.

Entries are put on a grid of integers, so that equal vectors are equal, sums are exact and centring loses nothing. Each distinct vector counts once in
the fit. A pass is one Spark job that adds up (X - mean)^T (X - mean) Q over the fit list for a thin Q; the driver holds nothing but matrices of
dimensions x block. A polynomial of the covariance damps all that lies below the block's smallest Ritz value; then QR and a Rayleigh-Ritz step, until the
residuals certify the eigenvectors. Vectors that are certified are locked: the recurrence is kept orthogonal to them, so that a dominant one can't drown the others.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

SCALE, SHIFT = 64, 1_000_000
#: Columns of the block beyond the components that are asked for: the wider, the fewer passes.
GUARD = 24
#: The highest degree of a filter, and how far it may lift the leading vector above the damped ones before the columns would grow alike.
DEGREE, LIFT = 12, 1e9
#: Certified: the residual, relative to the largest eigenvalue. Where rounding of the sums stops the descent before, RESIDUAL_ROUNDED must hold.
RESIDUAL, RESIDUAL_ROUNDED = 4e-15, 1e-12
MAX_ROUNDS = 200


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What is fitted: n vectors with the sums per dimension (without ``SHIFT``), eigenvectors as columns, their eigenvalues, and how well it holds."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean, from whole numbers, so that nothing cancels."""
    return (n * x - sums) / n


def grid(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is whole: neither it nor an entry is null, every entry is finite. The column ``x`` is its grid vector."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & finite & (F.size(vector) > 0)).withColumn("x", grid(F.col(vector)))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - SHIFT


def added(fit: DataFrame, d: int, each: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of ``each(rows)`` over all rows: within a task in numpy, over tasks in Spark by position. The driver gets one such array."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = each(_matrix(batch, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["v"])

    rows = fit.select("x").mapInArrow(task, f"v array<{kind}>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows), "int64" if kind == "long" else "float64")
    for i, v in rows:
        out[i] = v
    return out


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, high: float, low: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of the operator on q: at most 1 for eigenvalues in [0, low], growing fast above; 1 at ``high``."""
    half = low / 2
    first = scale = half / (high - half)
    before, now = q, (apply(q) - half * q) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (apply(now) - half * now) * (2 * after / half) - (scale * after) * before
        scale = after
    return now


def eigenvectors(covariance: Callable[[np.ndarray], np.ndarray], d: int, k: int, trace: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading k eigenpairs of a covariance that is known by its products only, and their largest relative residual.

    Raises if they can't be certified. Directions without variance are left out, so there may be fewer than k.
    """
    block = min(d, k + GUARD)
    q = np.linalg.qr(np.random.default_rng(17).standard_normal((d, block)))[0]
    worst = np.inf
    for _ in range(MAX_ROUNDS):
        product = covariance(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        residuals = np.linalg.norm(product - q * values, axis=0) / values[0]
        wanted = values[:k] > 64 * d * np.finfo(float).eps * trace
        before, worst = worst, residuals[:k][wanted].max(initial=0.0)
        if block == d or worst <= RESIDUAL or (worst <= RESIDUAL_ROUNDED and worst > before / 2):
            return q[:, :k][:, wanted], values[:k][wanted], float(worst)
        locked = int(np.argmax(np.append(residuals[:k] > RESIDUAL_ROUNDED, True)))
        low = max(values[-1], values[0] * 1e-9)
        rise = np.arccosh(max(2 * values[locked] / low - 1, 1 + 1e-9))
        degree = int(np.clip(np.log(LIFT) / rise, 2, DEGREE))
        fixed = q[:, :locked]
        free = lambda y: y - fixed @ (fixed.T @ y)
        lifted = chebyshev(lambda y: free(covariance(y)), q[:, locked:], max(values[locked], low * (1 + 1e-9)), low, degree)
        q = np.linalg.qr(np.hstack([fixed, lifted / np.linalg.norm(lifted, axis=0)]))[0]
    raise ArithmeticError(f"eigenvectors not certified after {MAX_ROUNDS} rounds: residual {worst:.1e}")


def fit_whitening(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Fits on the distinct ``x`` of rows of one dimension; None without variance (no rows, or one distinct vector)."""
    spark = rows.sparkSession
    head = rows.select(F.size("x").alias("d")).head()
    if head is None:
        return None
    d = head["d"]
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(folder)
    fit = spark.read.parquet(folder)
    total = added(fit, d, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n, sums = int(total[-1]), total[:-1]
    trace = float(added(fit, d, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]))[0]) / n
    if trace == 0:
        return None
    passes = 0

    def covariance(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def each(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return added(fit, d, each).reshape(q.shape) / n

    vectors, values, residual = eigenvectors(covariance, d, min(components, d), trace)
    found = Whitening(n, sums, vectors, values, trace, residual, 0.0, passes)

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([found.project(x), np.ones(len(x))])
        return w.T @ w

    second = added(fit, d, moments).reshape(len(values) + 1, -1) / n
    spread = second[:-1, :-1] - np.outer(second[-1, :-1], second[-1, :-1])
    return dataclasses.replace(found, identity_error=float(np.abs(spread - np.eye(len(values))).max()), passes=passes + 3)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sums of (n x - S)^2, exact: in 64 bits where that is sure to be enough, else in whole numbers of any size."""
    bound = max(int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)), 1)
    if bound * bound * x.shape[1] < 2**63:
        return pa.array(((n * x - sums) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """The usable rows with ``deviation`` decimal(38,0), ``whitened`` array<double>, and the same of all rows: ``n``, ``explained``, ``identity_error``.

    Rows with a null vector, or a null or non-finite entry, are dropped, and so are empty vectors and those of another dimension than most (of
    equally many the larger one counts). All other columns stay as they are, so null and repeated ids are rows like others; input columns ``x``,
    ``deviation``, ``whitened``, ``n``, ``explained`` and ``identity_error`` are replaced. Directions without variance give no component. Without
    variance at all, or without rows, the result is empty. Entries are taken to be below 2^53 / 64 / n.
    """
    rows = usable(vectors.drop("x", "deviation", "whitened", "n", "explained", "identity_error"), vector)
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    found = None
    if most is not None:
        rows = rows.where(F.size("x") == most["d"])
        found = fit_whitening(rows, components)
    if found is None:
        return rows.drop("x").where(F.lit(False)).withColumns({
            "deviation": F.lit(None).cast("decimal(38,0)"), "whitened": F.array().cast("array<double>"), "n": F.lit(0).cast("long"),
            "explained": F.array().cast("array<double>"), "identity_error": F.lit(0.0),
        })
    d = most["d"]
    kept = [c for c in rows.columns if c != "x"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            whitened = found.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * whitened.shape[1], pa.int32()), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), deviations(x, found.n, found.sums), lists], [*kept, "deviation", "whitened"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")
    return rows.mapInArrow(task, f"{types}, deviation decimal(38,0), whitened array<double>").withColumns({
        "n": F.lit(found.n).cast("long"), "explained": F.lit((found.values / found.trace).tolist()), "identity_error": F.lit(found.identity_error),
    })

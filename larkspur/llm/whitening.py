"""Whitening of embeddings: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, and each distinct one counts once in the fit list, so copies carry no weight. Sums are exact integers;
every pass over the fit list centres a batch by the mean, multiplies it with a block of directions and back, and sends one
dimension-by-block matrix per task, which Spark adds up. The covariance itself is never formed.

The block holds the wanted directions, guards behind them, and a few random ones that are new in each iteration. A polynomial of the
covariance, by the three-term Chebyshev recurrence, one pass a degree, stays below one on the interval of unwanted eigenvalues and grows fast above it.
The interval ends at the block's smallest Ritz value and begins at a lower bound from a Lanczos vector that rides along in the passes of
the first filter. QR and Rayleigh-Ritz follow. The result is certified once the residual of every wanted pair is below
`tolerance` times the largest eigenvalue, in an iteration whose new random directions went through the filter too: a direction
missed before would have shown up with the others. Without that after `most` iterations the job fails.

Rows with a null vector, or one that holds null or non-finite entries, take no part, nor do vectors of another length than the
commonest. Rows without an id and repeated rows are whitened like others. Components without variance (all vectors equal, or fewer than
`components` dimensions) are left out, so a table of one vector, like an empty one, gives no rows. Equal eigenvalues have any
orthonormal basis of their space. Other columns are not read. An entry beyond 2**53 is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, lean, table
from larkspur.llm.vectors import SCALE, matrix, sums_of, whole_vectors

COMPONENTS = 4
GUARDS = 16
FRESH = 4
DEGREE = 10
TOLERANCE = 1e-13
MOST = 60
#: A filter may lift the largest eigenvalue by e to this power: more would bury the other directions in its rounding errors.
GROWTH = 30.0


# --- passes over the fit list -----------------------------------------------------------------------------


@dataclass
class Moments:
    """Number of distinct vectors, their sum by dimension, and the sum of all squares; exact."""

    n: int
    total: list[int]
    squares: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])

    @property
    def trace(self) -> float:
        """Sum of the covariance's eigenvalues."""
        return (self.n * self.squares - sum(s * s for s in self.total)) / self.n**2


def moments(fit: DataFrame) -> Moments | None:
    def count(batch: pa.RecordBatch, totals: dict[int, np.ndarray]) -> None:
        x = matrix(batch)
        row = np.append(x.sum(axis=0).astype(object), [int((x * x).sum()), len(x)])
        totals[0] = totals[0] + row if totals else row

    found = sums_of(fit, count)
    return Moments(found[0][-1], found[0][:-2], found[0][-2]) if found else None


def centred(batch: pa.RecordBatch, mean: np.ndarray) -> np.ndarray:
    return matrix(batch).astype(np.float64) - mean


def gram(fit: DataFrame, mean: np.ndarray, block: np.ndarray, project: bool = False) -> np.ndarray:
    """ZᵀZ times the block, for centred rows Z; with `project` the block's own (Z block)ᵀ(Z block)."""
    width = block.shape[1]
    names = [f"c{j}" for j in range(width)]

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width if project else len(mean), width))
        for batch in batches:
            z = centred(batch, mean)
            image = z @ block
            total += (image if project else z).T @ image
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, total.T)], names=["row", *names])

    parts = fit.mapInArrow(add, "row long, " + ", ".join(f"{c} double" for c in names))
    summed = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return np.array([row[1:] for row in sorted(summed)])


# --- filter and certificate -------------------------------------------------------------------------------


@dataclass
class Basis:
    """Unit eigenvectors as columns by falling eigenvalue, and how they were certified."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    passes: int = 0
    iterations: list[float] = field(default_factory=list)


def chebyshev(multiply, block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The block under the Chebyshev polynomial of that degree which is small on [low, high] and one at `top`."""
    centre, half = (low + high) / 2, (high - low) / 2
    scale = half / (top - centre)
    first = scale
    before, now = block, (multiply(block) - centre * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        following = (multiply(now) - centre * now) * (2 * after / half) - (scale * after) * before
        before, now, scale = now, following, after
    return now


class Lanczos:
    """One vector that rides along: from its recurrence follows how low the spectrum reaches."""

    def __init__(self, start: np.ndarray):
        self.before, self.now, self.beta = np.zeros_like(start), start / np.linalg.norm(start), 0.0
        self.alphas: list[float] = []
        self.betas: list[float] = []

    def advance(self, image: np.ndarray) -> None:
        alpha = float(self.now @ image)
        rest = image - alpha * self.now - self.beta * self.before
        self.alphas.append(alpha)
        self.beta = float(np.linalg.norm(rest))
        self.betas.append(self.beta)
        self.before, self.now = self.now, rest / self.beta if self.beta else np.zeros_like(rest)

    def lowest(self) -> float:
        """Smallest Ritz value less its residual."""
        if not self.alphas:
            return 0.0
        inner = np.diag(self.alphas) + np.diag(self.betas[:-1], 1) + np.diag(self.betas[:-1], -1)
        values, vectors = np.linalg.eigh(inner)
        return max(0.0, float(values[0] - abs(self.betas[-1] * vectors[-1, 0])))


def leading(
    multiply, dimension: int, k: int, guards: int = GUARDS, fresh: int = FRESH, degree: int = DEGREE,
    tolerance: float = TOLERANCE, most: int = MOST, seed: int = 13,
) -> Basis:
    """The k leading eigenpairs of a symmetric operator without negative eigenvalues, given as its product with a block."""
    random = np.random.default_rng(seed)
    width = min(dimension, k + guards + fresh)
    k, passes, history = min(k, dimension), 0, []
    lanczos = Lanczos(random.standard_normal(dimension))

    def counted(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return multiply(block)

    def riding(block: np.ndarray) -> np.ndarray:
        if len(lanczos.alphas) and lanczos.betas[-1] <= 1e-12 * max(lanczos.alphas):
            return counted(block)
        both = counted(np.column_stack([block, lanczos.now]))
        lanczos.advance(both[:, -1])
        return both[:, :-1]

    block = np.linalg.qr(random.standard_normal((dimension, width)))[0]
    for iteration in range(most + 1):
        image = counted(block)
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = block @ turn, image @ turn
        residuals = np.linalg.norm(image - ritz * values, axis=0)[:k]
        history.append(float(residuals.max()))
        settled = residuals.max() <= tolerance * values[0]
        if settled and (iteration or width == dimension):
            return Basis(ritz[:, :k], values[:k], residuals, passes, history)
        kept = width if width == dimension else width - fresh
        high = max(float(values[kept - 1]), 1e-14 * float(values[0]))
        low, top = min(lanczos.lowest(), 0.9 * high), max(float(values[0]), high * 1.0001)
        steps = min(degree, max(1, int(GROWTH / math.acosh((2 * top - low - high) / (high - low)))))
        start = np.column_stack([ritz[:, :kept], random.standard_normal((dimension, width - kept))])
        filtered = chebyshev(riding if iteration == 0 else counted, start, low, high, top, steps)
        # columns are scaled alike before QR: the filter leaves unwanted ones tiny
        lengths = np.linalg.norm(filtered, axis=0)
        block = np.linalg.qr(filtered / np.where(lengths > 0, lengths, 1))[0]
    raise RuntimeError(f"not certified after {most} iterations: residuals {history[-3:]}, largest eigenvalue {values[0]}")


# --- whole jobs -------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What the fit list says: moments, certified basis, and the identity error of the whitened fit list."""

    moments: Moments
    basis: Basis
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.moments.trace for e in self.basis.values]

    @property
    def directions(self) -> np.ndarray:
        """Columns that whiten a centred vector."""
        return self.basis.vectors / np.sqrt(self.basis.values)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, **options) -> Whitening | None:
    """Fitted on the distinct vectors `x`; None without variance."""
    found = moments(fit)
    if found is None or found.trace <= 0:
        return None
    mean, n = found.mean, found.n
    basis = leading(lambda block: gram(fit, mean, block) / n, len(mean), components, **options)
    real = basis.values > basis.values[0] * len(mean) * 1e-14
    signs = np.sign(basis.vectors[np.abs(basis.vectors).argmax(axis=0), np.arange(len(real))])  # so that reruns agree
    basis.vectors, basis.values, basis.residuals = (basis.vectors * signs)[:, real], basis.values[real], basis.residuals[real]
    whitening = Whitening(found, basis, math.nan)
    covariance = gram(fit, mean, whitening.directions, project=True) / n
    whitening.identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return whitening


def apply_whitening(rows: DataFrame, model: Whitening) -> DataFrame:
    """Rows (id, component, deviation, whitened); the deviation is exact."""
    mean, directions, n, total = model.moments.mean, model.directions, model.moments.n, model.moments.total
    count = directions.shape[1]

    @lean
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
            kind = np.int64 if reach * reach * len(total) < 2**63 else object
            away = n * x.astype(kind) - np.array(total, dtype=kind)
            deviation = pa.array([int(v) for v in (away * away).sum(axis=1)], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(len(x)), count))
            component = pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32())
            white = (x.astype(np.float64) - mean) @ directions
            arrays = [batch.column("id").take(row), component, deviation.take(row), pa.array(white.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "component", "deviation", "whitened"])

    return rows.mapInArrow(project, "id long, component int, deviation decimal(38,0), whitened double")


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, **options
) -> tuple[DataFrame, Whitening | None]:
    """All remaining rows (id, component, deviation, whitened), and the model they were whitened with."""
    scratch = Scratch(df.sparkSession, "whitening")
    rows = scratch.keep(whole_vectors(df, key, vector, None, scale))
    fit = scratch.keep(rows.select("x").distinct())
    model = fit_whitening(fit, components, **options)
    scratch.drop(fit)
    if model is None:
        return rows.sparkSession.createDataFrame([], "id long, component int, deviation decimal(38,0), whitened double"), None
    return apply_whitening(rows, model), model


def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading components; a deviation beyond 64 bits would be null here, and is not in `whiten`."""
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    explained = model.explained if model else [math.nan]
    error = model.identity_error if model else math.nan
    return rows.select(
        F.col("id").alias("vec_id"),
        "component",
        F.lit(model.moments.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


QUERIES = {"op13_chebyshev_whitening": op13_chebyshev_whitening}
ORACLE: dict[str, str] = {}

"""Whitening of embeddings by principal components of their covariance.

The covariance is summed where the vectors are: each task sends one number per pair of dimensions.
Its eigenvectors start from a solver in single precision and are corrected by the iteration of
Ogita and Aishima, "Iterative refinement for symmetric eigenvalue decomposition" (JJIAM 2018), in
extended precision: four matrix products a step, with an error that is squared by each. Eigenvalues
too close for a step to part (its own error bound says so) form clusters; for these the matrix
is projected on their subspace, shifted and scaled to its own size, and solved there in the same
way, as in part II of that work (JJIAM 2019).

Components are integers, floor(scale * c) + shift. Sums are exact; so is the covariance as long as
the sums of products of differences from the rounded mean stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.session import ship_package

# Steps of refinement. Each squares the error, until steps are small or no longer shrink: rounding.
MOST_STEPS, SMALL_STEP = 12, 1e-14
# Components whose variance is below this share of the largest are rounding, not data.
LEAST_SHARE = 1e-12
# Digits of the lower part in which exact integers beyond a long travel.
PART = 10**18


@dataclass(frozen=True)
class Whitening:
    """`sums`: exact sums per dimension over `n` vectors; columns of `axes` are unit eigenvectors by
    falling eigenvalue `values`."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The mean, rounded to integers, which differences are exact against."""
        return np.array([round(Fraction(s, self.n)) for s in self.sums], np.int64)

    @property
    def offset(self) -> np.ndarray:
        """The mean less `centre`."""
        return np.array([float(Fraction(s, self.n) - int(c)) for s, c in zip(self.sums, self.centre, strict=True)])


def _step(a: np.ndarray, x: np.ndarray, together: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One refinement of the eigenvectors `x` of `a`: (vectors, values, largest correction, least gap it can part).

    Pairs that are `together` (null: those closer than the gap) are only made orthogonal.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    gap = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    away = values[None, :] - values[:, None]
    close = np.abs(away) <= gap if together is None else together
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, away))
    return x + x @ e, values, float(np.abs(e).max()), gap


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Numbers of the values that hang together by steps of at most `gap`, one or more."""
    order = np.argsort(-values)
    return np.split(order, np.flatnonzero(np.abs(np.diff(values[order])) > gap) + 1)


def refined_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors in columns) of a symmetric matrix, to double precision.

    Vectors of equal eigenvalues are some orthonormal basis of their space.
    """
    values, vectors = _refined(np.asarray(matrix, np.longdouble))
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors = vectors / np.sqrt((vectors**2).sum(axis=0))
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values[order].astype(np.float64), (vectors * np.where(largest < 0, -1, 1)).astype(np.float64)


def _refined(a: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of `a`; values that differ by at most `floor` count as equal."""
    a = (a + a.T) / 2
    size = np.abs(a).max()
    if len(a) == 1 or size <= floor or size == 0:
        return np.diag(a).copy(), np.eye(len(a), dtype=a.dtype)
    a, floor = a / size, max(float(np.finfo(a.dtype).eps) * len(a), floor / float(size))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    x, values, last, gap = _step(a, x, None)
    clusters = _clusters(values, max(gap, floor))
    number = np.zeros(len(a), np.int64)
    for i, members in enumerate(clusters):
        number[members] = i
    together = number[:, None] == number[None, :]
    for _ in range(MOST_STEPS):
        x, values, change, _ = _step(a, x, together)
        if change < SMALL_STEP or last / 4 < change < np.sqrt(SMALL_STEP):
            break
        last = change
    x = x @ (1.5 * np.eye(len(a), dtype=a.dtype) - 0.5 * (x.T @ x))
    for members in clusters:
        own = x[:, members]
        part = own.T @ (a @ own)
        part = part - np.trace(part) / len(members) * np.eye(len(members), dtype=a.dtype)
        if len(members) < len(a) or np.abs(part).max() < 0.5:  # smaller or, after the shift, of another size
            x[:, members] = own @ _refined(part, floor)[1]
    return np.diag(x.T @ (a @ x)) * size, x


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x) of the rows whose vector takes part."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & sound
    x = F.transform(c, lambda v: F.floor(v * scale).cast("long") + F.lit(shift).cast("long"))
    return rows.where(usable).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension, in two halves so that no long overflows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for part in parts:
            x = _matrix(part.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)], names=["d", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    found = vectors.select("x").mapInArrow(batches, "d int, n long, high long, low long").groupBy("d").agg(F.sum("n").alias("n"), wide("high"), wide("low"))
    by = {r["d"]: r for r in found.collect()}
    return (by[0]["n"] if by else 0), [(int(by[d]["high"]) << 32) + int(by[d]["low"]) if by else 0 for d in range(dims)]


def _products(vectors: DataFrame, dims: int, of, width: int) -> np.ndarray:
    """Sum over all vectors of the outer product of `of(x)`, preceded by a 1: (width + 1) squared numbers.

    Each task sends one row per pair of columns.
    """
    pairs = np.triu_indices(width + 1)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for part in parts:
            y = of(_matrix(part.column(0), dims))
            y = np.hstack([np.ones((len(y), 1)), y])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs[0])), pa.int64()), pa.array(total[pairs])], names=["cell", "v"])

    out = np.zeros((width + 1, width + 1))
    for r in vectors.select("x").mapInArrow(batches, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        i, j = pairs[0][r["cell"]], pairs[1][r["cell"]]
        out[i, j] = out[j, i] = r["v"]
    return out


def commonest_length(vectors: DataFrame) -> int:
    """The number of components that most vectors have; of equally common ones the larger; 0 without vectors."""
    first = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return first["dims"] if first else 0


def fit_whitening(vectors: DataFrame, dims: int) -> Whitening:
    """Mean and principal components of all `vectors` (column x, of length `dims`).

    A number per dimension and one per pair of dimensions reach the driver, whatever the rows.
    """
    n, sums = _sums(vectors, dims)
    model = Whitening(n, tuple(sums), np.zeros((dims, 0)), np.zeros(0), 0.0)
    if not n:
        return model
    centre, offset = model.centre, model.offset
    raw = _products(vectors, dims, lambda x: (x - centre).astype(np.float64), dims)
    covariance = raw[1:, 1:].astype(np.longdouble) / n - np.outer(offset, offset).astype(np.longdouble)
    values, axes = refined_eigen(covariance)
    return Whitening(n, tuple(sums), axes, values, float(np.trace(covariance)))


def usable_components(model: Whitening, most: int) -> int:
    """Components up to `most` whose variance is more than rounding."""
    if not len(model.values) or model.values[0] <= 0:
        return 0
    return int((model.values[:most] > LEAST_SHARE * model.values[0]).sum())


def projector(model: Whitening, components: int):
    """Vectors x to their whitened components."""
    centre, offset = model.centre, model.offset
    scaled = model.axes[:, :components] / np.sqrt(model.values[:components])
    return lambda x: ((x - centre).astype(np.float64) - offset) @ scaled


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened vectors' measured covariance minus the identity."""
    sums = _products(vectors, len(model.sums), projector(model, components), components) / model.n
    return float(np.abs(sums[1:, 1:] - np.outer(sums[0, 1:], sums[0, 1:]) - np.eye(components)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of (n * x - S)^2 of each row, exact, as (value // PART, value % PART)."""
    top = max(int(x.max()), -int(x.min())) * n + max(abs(s) for s in sums) if len(x) else 0
    if top < 1 << 63:
        apart = x * n - np.array(sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            total = (apart * apart).sum(axis=1)
            return total // PART, total % PART
    apart = x.astype(object) * n - np.array(sums, object)
    total = [sum(v * v for v in row) for row in apart]
    return np.array([t // PART for t in total], np.int64), np.array([t % PART for t in total], np.int64)


def whitened_vectors(
    rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is a decimal(38,0). Vectors that are null, empty or hold a null or non-finite
    component are left out, as are those whose length is not the commonest one. Repeated rows, also
    with one id or a null id, each count in the fit and have their own rows. Components beyond the
    dimensions, and those without variance (a single vector, equal vectors, dependent dimensions),
    have no rows; so has an empty table. A component that no long can hold raises. Other columns
    play no part.
    """
    ship_package(rows.sparkSession)
    vectors = integer_vectors(rows, id_col, vector_col, scale, shift)
    dims = commonest_length(vectors)
    vectors = vectors.where(F.size("x") == dims)
    model = fit_whitening(vectors, dims)
    count = usable_components(model, components)
    error = identity_error(vectors, model, count) if count else 0.0
    project = projector(model, count) if count else None

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(1), dims)
            high, low = (np.repeat(v, count) for v in deviations(x, model.n, model.sums))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(x)), count))),
                    pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    pa.array(high), pa.array(low), pa.array(project(x).ravel()),
                    pa.array(np.tile(model.values[:count] / model.trace, len(x))),
                ],
                names=["vec_id", "component", "high", "low", "whitened", "explained"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, high long, low long, whitened double, explained double"
    found = (vectors if count else vectors.limit(0)).mapInArrow(batches, schema)
    deviation = (F.col("high").cast("decimal(20,0)") * F.lit(PART).cast("decimal(19,0)") + F.col("low").cast("decimal(38,0)")).cast("decimal(38,0)")
    return found.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), deviation.alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))

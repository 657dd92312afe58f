"""Movie vectors: cleaning, lookup tables for tasks, and column arithmetic on arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table up to this size is sent to every task; every Python worker has its own copy.
TASK_TABLE_BYTES = 256 * 1024


@dataclass(frozen=True)
class VectorSpace:
    """One kind of movie vector: `movies` has (movie_id, vector).

    `default` stands in for movies without one (zeros unless given); `profiled` says
    whether a rating-weighted user profile is kept for it.
    """

    name: str
    movies: DataFrame
    dim: int
    kind: str = "float"
    default: tuple[float, ...] | None = None
    profiled: bool = True

    def default_column(self) -> Column:
        if self.default is None:
            return zeros(self.dim, self.kind)
        return F.array(*[F.lit(v).cast(self.kind) for v in self.default])


def drop_bad_vectors(df: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    """Keep rows whose vector has the expected length."""
    return df.where(F.size(column) == F.lit(dim))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 when either side has no length."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))


def elementwise_product(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a * b)


def zeros(dim: int, kind: str = "float") -> Column:
    return F.array_repeat(F.lit(0.0).cast(kind), dim)


def with_vector(df: DataFrame, space: VectorSpace, *, hint_small: bool = True) -> DataFrame:
    """Left lookup of a movie vector; missing ones become zeros and are flagged."""
    found, missing = f"{space.name}_vector", f"missing_{space.name}"
    movies = space.movies.select("movie_id", F.col("vector").alias(found))
    if hint_small and small_enough(space):
        movies = F.broadcast(movies)
    joined = df.join(movies, "movie_id", "left")
    return joined.withColumn(missing, F.col(found).isNull()).withColumn(
        found, F.coalesce(F.col(found).cast(f"array<{space.kind}>"), space.default_column())
    )


def small_enough(space: VectorSpace, limit_bytes: int = TASK_TABLE_BYTES) -> bool:
    width = 4 if space.kind == "float" else 8
    return space.movies.count() * (space.dim * width + 8) <= limit_bytes


class VectorTable:
    """Sorted ids and a dense matrix; the last row is the default vector."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, default: tuple[float, ...] | None = None):
        order = np.argsort(ids, kind="stable")
        last = np.zeros((1, matrix.shape[1]), dtype=matrix.dtype)
        if default is not None:
            last[0] = default
        self.ids = ids[order]
        self.matrix = np.vstack([matrix[order], last])

    def rows(self, movie_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, missing flags) for the given movies."""
        if len(self.ids) == 0:
            at = np.zeros(len(movie_ids), dtype=np.int64)
            missing = np.ones(len(movie_ids), dtype=bool)
        else:
            at = np.minimum(np.searchsorted(self.ids, movie_ids), len(self.ids) - 1)
            missing = self.ids[at] != movie_ids
        return self.matrix[np.where(missing, len(self.ids), at)], missing


def vector_table(space: VectorSpace) -> VectorTable:
    """Collect one vector table; call only after `small_enough`."""
    rows = space.movies.select(F.col("movie_id").cast("bigint"), F.col("vector").cast(f"array<{space.kind}>"))
    table = rows.toArrow()
    parts = [stack_lists(chunk, space.dim) for chunk in table.column("vector").chunks]
    empty = np.zeros((0, space.dim), dtype="float32" if space.kind == "float" else "float64")
    matrix = np.concatenate(parts) if parts else empty
    return VectorTable(table.column("movie_id").to_numpy(), matrix, space.default)


def stack_lists(array, dim: int) -> np.ndarray:
    """An Arrow list array of equal lengths as a 2-d numpy array."""
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), dim)


def without_null_lists(df: DataFrame) -> DataFrame:
    """Empty lists instead of null ones: per row, Spark's Arrow writer walks back over all nulls before it."""
    lists = {f.name: f.dataType.simpleString() for f in df.schema if f.dataType.typeName() == "array"}
    return df.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in lists.items()})

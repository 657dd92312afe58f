"""Exact top-k search by inner product over vector-approximation files.

After Weber, Schek and Blott, "A Quantitative Analysis and Performance Study for Similarity-Search
Methods in High-Dimensional Spaces" (VLDB 1998). Every vector has an approximation of one byte per
dimension, the number of its cell; cells end at quantiles, so a few far vectors widen the outermost
cells only. A query's product with any vector of a cell lies between two bounds, which four matrix
products give for a block of queries and a block of approximations:

1. all approximations are scanned; in a block, those whose upper bound reaches the block's k-th
   lower bound stay, over all blocks those that reach the k-th lower bound of all;
2. exact vectors are read in the order of their upper bounds, in rounds: first the k best, then each
   time `ROUND_GROWTH` times as many, as far as the upper bound reaches the k-th exact score so far.
   When no bound does, what is left cannot enter the result, so it is certain.

Components are integers, floor(scale * x), so bounds and scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.session import ship_package, staged

# Rows of one block of approximations and of one block of queries: 0.5 MB and 2 MB at 64 dimensions.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
# Queries that meet a block of approximations in one matrix product.
QUERIES_AT_ONCE = 256
CELLS = 256
# Borders beyond the outermost quantiles, as multiples of their distance from the median.
FENCES = (0.25, 0.5, 1.0, 3.0)
# Vectors read up to a round, as a multiple of those up to the round before.
ROUND_GROWTH = 4
# Fixed value: the largest integer below which doubles hold every integer.
EXACT_DOUBLE = float(1 << 53)


@dataclass(frozen=True)
class Marks:
    """Per dimension the largest component of each cell, ascending, and the least component of all."""

    low: np.ndarray
    tops: np.ndarray

    @property
    def bottoms(self) -> np.ndarray:
        """The least integer of each cell."""
        return np.concatenate([self.low[:, None], self.tops[:, :-1] + 1], axis=1)

    def cells(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(v.shape, np.uint8)
        for d, tops in enumerate(self.tops):
            out[:, d] = np.searchsorted(tops, v[:, d])
        return out

    def ends(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest vectors of the cells."""
        dims = np.arange(len(self.low))
        return self.bottoms[dims, cells], self.tops[dims, cells]


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): components as floor(scale * x), x as double; vectors that take no part are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound
    return rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def without_surplus_copies(vectors: DataFrame, k: int) -> DataFrame:
    """At most k + 1 rows of each distinct vector, those with the least ids.

    Equal vectors score alike and ties go to the smaller id: of the others none can be among the
    k best of any query, not even of one that is among the copies itself. The limit is applied in
    each task before rows are sent, so a vector with very many copies is not gathered.
    """
    turn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return vectors.withColumn("turn", turn).where(F.col("turn") <= k + 1).drop("turn")


def marks_of(vectors: DataFrame) -> Marks:
    """Cell borders at quantiles of all vectors; one row of `CELLS` numbers per dimension reaches the driver.

    Any borders give right bounds, so approximate quantiles do. Beyond the outermost quantiles cells end at
    multiples of their distance from the median, so that ordinary vectors share no cell with far ones.
    Zeros, which fill up short vectors, lie inside.
    """
    inner = CELLS - 1 - 2 * len(FENCES)
    shares = F.lit([(i + 1) / (inner + 1) for i in range(inner)])
    each = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d")
    rows = each.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", shares, 5000).alias("tops")).orderBy("d").collect()
    low, high = (np.array([f(r[n], 0) for r in rows], np.int64) for f, n in ((min, "low"), (max, "high")))
    tops = np.array([r["tops"] for r in rows], np.float64).reshape(len(rows), inner)
    median, fences = tops[:, inner // 2, None], np.array(FENCES)
    beyond = [tops[:, :1] + (tops[:, :1] - median) * fences, tops, tops[:, -1:] + (tops[:, -1:] - median) * fences]
    inside = np.clip(np.sort(np.hstack(beyond), axis=1), low[:, None], high[:, None]).astype(np.int64)
    inside = np.clip(inside, low[:, None], high[:, None])  # once more, as doubles round large integers
    return Marks(low, np.hstack([inside, high[:, None]]))


def _matrix(vectors, dims: int) -> np.ndarray:
    """Rows of components; shorter vectors are filled up with zeros."""
    if dims and all(len(v) == dims for v in vectors):
        return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(-1, dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def approximations(vectors: DataFrame, marks: Marks) -> DataFrame:
    """(row, id, cells, place): the approximation file; `place` spreads rows evenly over blocks."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = _matrix(part.column(2).to_pylist(), len(marks.low))
            cells = pa.array([c.tobytes() for c in marks.cells(v)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cells, part.column(3)], names=["row", "id", "cells", "place"])

    placed = vectors.select("row", "id", "v", F.xxhash64("id", "v").alias("place"))
    return placed.mapInArrow(batches, "row long, id long, cells binary, place long")


def _scan(marks: Marks, k: int):
    """Candidates of a block of queries in a block of approximations, with their bounds."""

    def candidates(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "row", "lower", "upper"]
        dims = len(marks.low)
        if queries.empty or rows.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        ids, numbers = rows["id"].to_numpy(), rows["row"].to_numpy()
        least, largest = marks.ends(np.frombuffer(b"".join(rows["cells"]), np.uint8).reshape(len(ids), dims))
        extreme = float(np.abs(marks.low).max(initial=0)) + float(np.abs(marks.tops).max(initial=0))
        out = []
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = queries.iloc[at : at + QUERIES_AT_ONCE]
            q = _matrix(part["v"].tolist(), dims)
            limit = float(np.abs(q).astype(float).sum(axis=1).max()) * extreme
            kind = np.float64 if limit < EXACT_DOUBLE else object  # Python's integers where doubles would round
            up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
            low_ends, high_ends = least.astype(kind).T, largest.astype(kind).T
            lower, upper = up @ low_ends + down @ high_ends, up @ high_ends + down @ low_ends
            for i, own in enumerate(part["query_id"].to_numpy()):
                others = np.flatnonzero(ids != own)
                bounds = lower[i][others]
                if len(others) > k:
                    limit_i = np.sort(bounds)[-k] if kind is object else np.partition(bounds, len(bounds) - k)[len(bounds) - k]
                    others = others[upper[i][others] >= limit_i]
                out.append(pd.DataFrame({
                    "query_id": own, "row": numbers[others], "lower": lower[i][others].astype("int64"), "upper": upper[i][others].astype("int64"),
                }))
        return pd.concat(out)[names] if out else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})

    return candidates


def _reaching(rows: DataFrame, bound: Column, limit_of: str, k: int) -> DataFrame:
    """Rows whose `bound` reaches the k-th largest `limit_of` of their query (all, if it has fewer)."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(limit_of)))
    best = rows.select("query_id", limit_of).withColumn("turn", turn).where(F.col("turn") <= k)
    limits = best.groupBy("query_id").agg(F.min(limit_of).alias("limit"), F.count("*").alias("n"))
    reached = rows.join(limits, "query_id").where((F.col("n") < k) | (bound >= F.col("limit")))
    return reached.drop("limit", "n")


def _exact(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with their exact score; their vectors and the queries' are read here."""
    pairs = found.join(vectors, "row").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
    product = F.zip_with("v", "q", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long")))
    score = F.aggregate(product, F.lit(0).cast("long"), lambda total, x: total + x)
    return pairs.select("query_id", F.col("id").alias("vec_id"), score.alias("score"))


def exact_top_k(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to the smaller id.

    Both tables have the id and vector column; candidates of a query are all `rows` with another
    id. Vectors that are null or hold a null or non-finite component, and rows with a null id, take
    no part; an empty vector scores 0 with all. A query id in several rows is one query, with the largest of its vectors; a
    candidate id in several rows is a candidate in each of them (copies of one vector beyond the
    k + 1 least ids are left out, since they cannot be in a result). Of vectors of different
    lengths the shorter are read as if filled up with zeros. A query with fewer than k candidates
    gets them all; empty tables give no rows. A component or score that no long can hold raises.
    Other columns play no part.
    """
    ship_package(rows.sparkSession)
    asked = integer_vectors(queries, id_col, vector_col, scale)
    asked = staged(asked.groupBy(F.col("id").alias("query_id")).agg(F.max("v").alias("v")))
    vectors = without_surplus_copies(integer_vectors(rows, id_col, vector_col, scale), k)
    vectors = staged(vectors.withColumn("row", F.monotonically_increasing_id()))
    blocks, query_blocks = max(1, -(-vectors.count() // BLOCK_ROWS)), max(1, -(-asked.count() // BLOCK_QUERIES))
    marks = marks_of(vectors.select("v").union(asked.select("v")))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("cb", spread(blocks))
    file = staged(approximations(vectors, marks))
    right = file.withColumn("cb", F.pmod("place", F.lit(blocks)).cast("int")).withColumn("qb", spread(query_blocks))
    scan = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_scan(marks, k), "query_id long, row long, lower long, upper long")
    near = staged(_reaching(staged(scan), F.col("upper"), "lower", k))

    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "row"))
    left, upto = staged(near.withColumn("turn", turn)), k
    scores = staged(_exact(left.where(F.col("turn") <= k).select("query_id", "row"), vectors, asked))
    while True:
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        limits = scores.withColumn("place", best).where(F.col("place") <= k).groupBy("query_id").agg(F.min("score").alias("limit"))
        left = staged(left.where(F.col("turn") > upto).join(limits, "query_id").where(F.col("upper") >= F.col("limit")).drop("limit"))
        if left.isEmpty():
            break
        upto *= ROUND_GROWTH
        scores = scores.union(staged(_exact(left.where(F.col("turn") <= upto).select("query_id", "row"), vectors, asked)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

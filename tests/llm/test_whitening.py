"""Whitening against numpy's own solver, exact deviations, and eigenvalues that are hard to part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm.queries import op13_whitening
from tastemill.llm.whitening import refined_eigen, whitened_vectors

VECTORS = "vec_id long, embedding array<float>, component string"


def orthogonal(n, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(n) - 0.5 * q.T @ q)
    return q


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 64), [5.0] * 10 + [1.0] * 10, [*(1 + 1e-9 * i for i in range(10)), 3, 3 + 1e-12, 4], [1, 1e-3, 1e-6, 1e-9, 1e-12], [1 + 1e-14 * i for i in range(20)], [0.0, 0.0, 0.0], [-3.0, 2.0, 0.0], [2.0],
])
def test_refined_pairs_to_double_precision(values):
    q = orthogonal(len(values))
    a = (q * np.asarray(values, np.longdouble)) @ q.T
    found, x = refined_eigen(a)
    size = max(1e-300, np.abs(np.asarray(values)).max())
    assert np.abs(found - np.sort(np.asarray(values, float))[::-1]).max() <= 4e-16 * size
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= 2e-15
    assert np.abs((a + a.T) / 2 @ x - x * found).max() <= 1e-15 * size


def test_vectors_of_close_values_are_parted():
    q = orthogonal(5)
    _, x = refined_eigen((q * np.array([1, 1 + 1e-7, 1 + 2e-7, 3, 3 + 1e-8], np.longdouble)) @ q.T)
    assert np.abs(np.abs(x.T @ q[:, [4, 3, 2, 1, 0]].astype(float)) - np.eye(5)).max() < 1e-10


def plain(vectors, components):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(axis=0)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, centred @ axes[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def test_whole_query_equals_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, whitened, explained = plain([r["embedding"] for r in rows], 8)
    got = op13_whitening(spark, sf).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"]) for r in got] == [(r["vec_id"], c) for r in rows for c in range(1, 9)]
    found = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    signs = np.sign((found * whitened).sum(axis=0))
    assert np.abs(found * signs - whitened).max() < 1e-9
    assert [r["deviation"] for r in got[::8]] == deviation and {r["n"] for r in got} == {n}
    assert np.allclose([r["explained"] for r in got[:8]], explained, rtol=1e-10)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and 0 <= got[0]["identity_error"] < 1e-9


def test_rows_that_take_no_part_and_large_components(spark):
    good = [(1, [1.0, 2.0, 9.0]), (2, [2.0, -1e6, 0.5]), (2, [2.0, -1e6, 0.5]), (None, [-3.0, 4.0, 3e5]), (5, [0.0, 0.0, 0.0])]
    bad = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [float("nan")] * 3), (14, [float("-inf"), 0.0, 0.0]), (15, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "old") for r in good + bad], VECTORS)
    got = whitened_vectors(frame, scale=1 << 30)
    x = [[math.floor((1 << 30) * float(np.float32(c))) + 100_000 for c in v] for _, v in good]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = sorted(((i, sum((5 * c - s) ** 2 for c, s in zip(row, sums, strict=True))) for (i, _), row in zip(good, x, strict=True)), key=str)
    assert sorted(((r["vec_id"], int(r["deviation"])) for r in got.where("component = 1").collect()), key=str) == want
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened_vectors(frame).where("component = 1").count() == 5


def test_no_variance_no_rows(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0], "") for i in range(4)], VECTORS)
    assert whitened_vectors(frame).count() == whitened_vectors(frame.limit(1)).count() == whitened_vectors(frame.limit(0)).count() == 0
    line = frame.withColumn("embedding", F.transform("embedding", lambda x: (x * F.col("vec_id")).cast("float")))
    assert {r["component"] for r in whitened_vectors(line).collect()} == {1}

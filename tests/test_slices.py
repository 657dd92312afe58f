"""Ordered slices, ranks and splits: equal to a plain sort, whatever the layout and skew."""

import pytest
from pyspark.sql import functions as F

from tastemill.operators import rank as rk
from tastemill.operators import slices as sl


@pytest.fixture(scope="module")
def rows(spark):
    """5000 ratings with many equal times; one user holds about a third of them."""
    df = spark.range(5000).select(
        F.pmod(F.col("id") * 379, F.lit(5003)).alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("bigint").alias("user_id"),
        (F.col("id") % 11).alias("movie_id"),
        F.lit(3.0).alias("rating"),
        F.timestamp_seconds(F.when(F.col("id") % 2 == 0, F.lit(1000)).otherwise(F.col("id") % 40)).alias("rating_timestamp"),
    )
    return df.repartition(5).persist()


def expected_ranks(rows):
    keys = sorted((r.rating_timestamp, r.id) for r in rows.collect())
    return {key[1]: i + 1 for i, key in enumerate(keys)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_global_rank_equals_sorting(rows, partitions):
    ranked = rk.global_rank(rows.repartition(partitions), ["rating_timestamp", "id"], rows_per_slice=300)
    assert {r.id: r.rn for r in ranked.collect()} == expected_ranks(rows)


def test_global_rank_uses_no_single_partition(rows):
    ranked = rk.global_rank(rows, ["rating_timestamp", "id"], rows_per_slice=300)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_hot_key_is_spread_over_slices(rows):
    plan = sl.plan_slices(rows, ["user_id", "rating_timestamp", "id"], rows_per_slice=300)
    sliced = sl.with_slice(rows, plan)
    assert plan.count > 10
    assert max(sl.slice_counts(sliced, plan)) < 1200
    assert sliced.where("user_id = 7").select(sl.SLICE).distinct().count() >= 4


def test_selection_narrows_down_to_exact_keys(rows, monkeypatch):
    monkeypatch.setattr(sl, "SELECT_LIMIT", 200)
    monkeypatch.setattr(sl, "MIN_ROWS_PER_SLICE", 100)
    keys = sl.keys_at_ranks(rows, ["rating_timestamp", "id"], [1, 2500, 5000, 6000])
    ranks = expected_ranks(rows)
    assert {rank: ranks[key[1]] for rank, key in keys.items()} == {1: 1, 2500: 2500, 5000: 5000}


@pytest.mark.parametrize("ranks", [[2500], list(range(1, 5001, 25))])
def test_all_ranks_share_the_passes(rows, monkeypatch, ranks):
    monkeypatch.setattr(sl, "SELECT_LIMIT", 300)
    monkeypatch.setattr(sl, "MIN_ROWS_PER_SLICE", 100)
    passes, plain = [], sl.plan_slices
    monkeypatch.setattr(sl, "plan_slices", lambda *a, **k: (passes.append(1), plain(*a, **k))[1])
    keys = sl.keys_at_ranks(rows, ["rating_timestamp", "id"], ranks)
    expected = expected_ranks(rows)
    assert {rank: expected[key[1]] for rank, key in keys.items()} == {r: r for r in ranks}
    assert len(passes) <= 2


def test_temporal_split_matches_row_numbers(rows):
    split = rk.temporal_split(rows, 0.8, 0.1)
    ranks = expected_ranks(rows)
    for r in split.collect():
        want = "train" if ranks[r.id] <= 4000 else "validation" if ranks[r.id] <= 4500 else "test"
        assert r.split == want


def test_temporal_split_needs_no_shuffle(spark):
    df = spark.range(100).select("id", F.timestamp_seconds("id").alias("rating_timestamp"))
    split = rk.temporal_split(df)
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    assert split.where("split = 'test'").count() == 10


@pytest.mark.parametrize(("fractions", "total", "ends"), [((0.7, 0.2), 10, (7, 8)), ((0.8, 0.1), 1000, (800, 900))])
def test_split_rows_follow_configured_decimals(fractions, total, ends):
    # 0.7 + 0.2 is 0.8999999999999999 as a float sum, and that value counts.
    assert rk.split_rows(total, *fractions) == ends


def test_fractions_must_sum_to_one():
    rk.check_fractions(0.8, 0.1, 0.1)
    with pytest.raises(ValueError):
        rk.check_fractions(0.8, 0.1, 0.2)


def test_dense_index_is_contiguous_in_key_order(rows):
    index = {r.user_id: r.user_idx for r in rk.dense_index(rows, "user_id", "user_idx", rows_per_slice=8).collect()}
    assert index == {u: i for i, u in enumerate(sorted(index))}
    assert len(index) == 50


def test_dense_index_on_strings(spark):
    names = spark.createDataFrame([("b",), ("a",), ("b",), ("ü",), (None,)], "name string")
    assert {r.name: r.i for r in rk.dense_index(names, "name", "i").collect()} == {"a": 0, "b": 1, "ü": 2}


def test_parts_have_exact_sizes(rows):
    parts = rk.number_parts(rows, ["rating_timestamp", "id"], 700, rows_per_slice=300)
    counts = {r.part_idx: r["count"] for r in parts.groupBy("part_idx").count().collect()}
    assert counts == {i: 700 for i in range(7)} | {7: 100}


def test_shuffle_order_is_repeatable_and_seeded(rows):
    once = {r.id: r.position for r in rk.shuffle_order(rows, 42, rows_per_slice=400).collect()}
    again = {r.id: r.position for r in rk.shuffle_order(rows.repartition(3), 42).collect()}
    other = {r.id: r.position for r in rk.shuffle_order(rows, 43).collect()}
    assert once == again
    assert once != other
    assert sorted(once.values()) == list(range(1, 5001))


@pytest.mark.parametrize("ties", [1, 400, 10**9])
def test_ranks_are_found_on_one_core_and_with_ties(spark, monkeypatch, ties):
    monkeypatch.setattr(sl, "SELECT_LIMIT", 50)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: 1))
    rows = spark.range(3000).select((F.col("id") / ties).cast("bigint").alias("t"), (F.col("id") % 1).alias("id"))
    keys = sorted((int(i // ties), 0) for i in range(3000))
    ranks = [1, 2, 399, 400, 401, 1500, 2999, 3000, 9999]
    assert sl.keys_at_ranks(rows, ["t", "id"], ranks) == {r: keys[r - 1] for r in ranks[:-1]}


def test_null_keys_have_no_rank(spark):
    rows = spark.createDataFrame([(1, 2), (None, 3)], "t bigint, id bigint")
    with pytest.raises(ValueError, match="null"):
        sl.keys_at_ranks(rows, ["t", "id"], [1])

"""Adaptive split: single steps, folds across slices, experiment table rules, the stream form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import experiment as ex
from tastemill.plans.recommend_jobs import experiment_feedback
from tastemill.streaming.split_stream import split_stream

POLICY = ex.SplitPolicy()
FEEDBACK = "experiment_id string, id bigint, rated_at timestamp, model_role string, rating double"


def plain_fold(rows, policy=POLICY, start=ex.Split(0.7, 0.3), ratings=0, total=0.0):
    state, promoted = start, None
    for row_id, role, rating in rows:
        if role == "candidate":
            ratings, total = ratings + 1, total + rating
        state = ex.next_split(policy, state, role, rating)
        if ex.promotes(policy, state, role, ratings, total):
            state, promoted = ex.PROMOTED, row_id
    return state, promoted, ratings


def feedback_frame(spark, logs):
    """Equal times in pairs, so ids decide."""
    rows = [(e, i, i // 2, role, rating) for e, log in logs.items() for i, role, rating in log]
    df = spark.createDataFrame(rows, "experiment_id string, id bigint, s bigint, model_role string, rating double")
    return df.withColumn("rated_at", F.timestamp_seconds("s")).drop("s")


def random_log(seed, size, first_id, high):
    rng = random.Random(seed)
    return [
        (first_id + i, rng.choice(["main", "candidate", "candidate", "other"]), rng.choice([1.0, 3.5, 4.0, 5.0] if rng.random() > high else [4.5, 5.0]))
        for i in range(size)
    ]


@pytest.fixture(scope="module")
def logs():
    """One experiment holds a third of the rows; one promotes early; one alternates; one never clamps."""
    neutral = [(90_000 + i, "main" if i % 2 else "candidate", 3.5) for i in range(400)]
    swing = [(80_000 + i, "candidate", 5.0 if (i // 7) % 2 else 1.0) for i in range(400)]
    small = {f"small-{n}": random_log(n, 15, 1000 * n, 0.2) for n in range(20)}
    return {"hot": random_log(1, 900, 50_000, 0.1), "good": random_log(2, 500, 60_000, 0.95), "neutral": neutral, "swing": swing, **small}


@pytest.mark.parametrize("rows_per_slice", [100_000, 60])
def test_fold_equals_sequential_walk(spark, logs, rows_per_slice):
    states = ex.split_states(feedback_frame(spark, logs).repartition(5), rows_per_slice=rows_per_slice)
    found = {r.experiment_id: r for r in states.collect()}
    assert set(found) == set(logs)
    for name, log in logs.items():
        state, promoted, ratings = plain_fold(log)
        got = found[name]
        assert (got.main_fraction, got.candidate_fraction) == (state.main, state.candidate), name
        assert (got.promoted_id, got.candidate_ratings, got.rows) == (promoted, ratings, len(log)), name
    assert found["good"].promoted


SHAPES = {
    "neutral": lambda i: ("main" if i % 2 else "candidate", 3.5),
    "balanced": lambda i: ("candidate", 5.0 if (i // 5) % 2 else 1.0),
    "high": lambda i: ("candidate", 5.0),
    "promoted while balanced": lambda i: ("candidate", 1.0 if i % 37 == 0 else 4.5) if i < 700 else ("main", 5.0 if i % 2 else 1.0),
    "low shares": lambda i: ("candidate" if i % 3 else "main", (5.0, 1.0, 1.0, 3.5, 2.0)[i % 5]),
    "just below": lambda i: ("candidate", (5.0, 3.5, 3.5)[i % 3]),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_two_passes_whatever_the_feedback(spark, monkeypatch, shape):
    """One experiment in 30 slices: the rows are folded twice at most, and not rating by rating."""
    passes, steps = [], []
    folded, step = ex._folded, ex.next_split
    monkeypatch.setattr(ex, "_folded", lambda *a: passes.append(1) or folded(*a))
    log = [(i, *SHAPES[shape](i)) for i in range(3000)]
    got = ex.split_states(feedback_frame(spark, {"one": log}), rows_per_slice=100).collect()
    state, promoted, ratings = plain_fold(log)
    assert [(r.main_fraction, r.candidate_fraction, r.promoted_id, r.candidate_ratings, r.rows) for r in got] == [(state.main, state.candidate, promoted, ratings, 3000)]
    assert len(passes) <= 3  # experiments within a slice, slices of the others, open runs
    monkeypatch.setattr(ex, "next_split", lambda *a: steps.append(1) or step(*a))
    fold = ex.Fold(graph := ex.SplitGraph(POLICY), ex.Split(0.7, 0.3))
    ids, roles, ratings = (list(c) for c in zip(*log, strict=True))
    ex.Feedback(graph, 0, 0.0, fold).add(np.array(ids), np.array(roles, object), np.array(ratings))
    assert fold.end == state and fold.promoted_id == promoted and len(steps) < 500


@pytest.mark.parametrize("seed", range(8))
def test_random_folds_over_many_slices(spark, seed):
    rng = random.Random(seed)
    logs = {f"e{n}": random_log(seed * 100 + n, rng.choice([5, 300, 900]), 100_000 * n, rng.random()) for n in range(5)}
    policy = ex.SplitPolicy(freeze_without_candidate=seed % 2 == 1, step=rng.choice([0.02, 0.013, 0.1]), promotion_average=rng.choice([3.0, 4.0]))
    starts = {e: (rng.random(), rng.random()) for e in logs}
    table = experiments(spark, [(e, "m", "c" if rng.random() < 0.7 else None, *starts[e], "active") for e in logs])
    challenged = {r.experiment_id: r.candidate_model_version is not None for r in table.collect()}
    got = {r.experiment_id: r for r in ex.split_states(feedback_frame(spark, logs), table, policy, rows_per_slice=40).collect()}
    for e, log in logs.items():
        state, promoted, ratings = plain_fold(log, policy, ex.Split(*starts[e], challenged[e]))
        assert (got[e].main_fraction, got[e].candidate_fraction, got[e].promoted_id, got[e].candidate_ratings) == (state.main, state.candidate, promoted, ratings), e


def test_single_steps():
    start = ex.Split(0.7, 0.3)
    assert ex.next_split(POLICY, start, "candidate", 4.0).candidate == pytest.approx(0.32)
    assert ex.next_split(POLICY, start, "candidate", 3.0).candidate == pytest.approx(0.28)
    assert ex.next_split(POLICY, start, "main", 3.5) == start
    assert ex.next_split(POLICY, start, "other", 5.0) == start
    assert ex.next_split(POLICY, ex.Split(0.79, 0.21), "main", 5.0).main == pytest.approx(0.8)


def test_promotion_rule():
    full = ex.Split(0.2, 0.8)
    assert ex.promotes(POLICY, full, "candidate", 10, 42.0)
    assert not ex.promotes(POLICY, full, "candidate", 9, 42.0)
    assert not ex.promotes(POLICY, full, "candidate", 10, 39.0)
    assert not ex.promotes(POLICY, ex.Split(0.3, 0.7), "candidate", 10, 42.0)
    assert not ex.promotes(POLICY, ex.Split(0.2, 0.8, False), "candidate", 10, 42.0)


def test_share_revives_after_promotion_unless_frozen():
    assert ex.next_split(POLICY, ex.PROMOTED, "main", 5.0).candidate == pytest.approx(0.2)
    frozen = ex.SplitPolicy(freeze_without_candidate=True)
    assert ex.next_split(frozen, ex.PROMOTED, "main", 5.0) == ex.PROMOTED


def experiments(spark, rows):
    df = spark.createDataFrame(
        rows, "experiment_id string, main_model_version string, candidate_model_version string, main_split_fraction double, candidate_split_fraction double, status string"
    )
    then = F.timestamp_seconds(F.lit(0))
    return df.withColumns({"created_at": then, "updated_at": then})


def test_feedback_job_continues_from_the_stored_state(spark, logs):
    now = F.timestamp_seconds(F.lit(10_000))
    log = logs["good"]
    first = experiment_feedback(
        feedback_frame(spark, {"good": log}).limit(0), experiments(spark, [("good", "m1", "c1", 0.7, 0.3, "active")]),
        feedback_frame(spark, {"good": log[:5]}), now,
    )
    second = experiment_feedback(first.log, first.experiments, feedback_frame(spark, {"good": log[5:]}), now)
    row = second.experiments.first()
    state, promoted, ratings = plain_fold(log)
    assert promoted is not None
    assert row.main_split_fraction == pytest.approx(state.main)
    assert (row.main_model_version, row.candidate_model_version) == ("c1", None)
    assert second.log.count() == len(log)
    assert second.states.first().candidate_ratings == ratings


def test_no_challenger_no_promotion(spark, logs):
    table = experiments(spark, [("good", "m1", None, 0.7, 0.3, "active")])
    state = ex.split_states(feedback_frame(spark, {"good": logs["good"]}), table).first()
    assert not state.promoted


def test_stream_ends_in_the_same_state(spark, logs, tmp_path):
    df = feedback_frame(spark, {n: logs[n] for n in ("hot", "good", "swing")})
    # Three files, each later in time than the one before.
    for i in range(3):
        part = df.where(F.pmod(F.col("id"), F.lit(10_000)).between(i * 300, i * 300 + 299))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = split_stream(stream.select("experiment_id", "id", "rated_at", "model_role", "rating")).writeStream.format("memory").queryName(
        "split_states"
    ).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("split_states").collect():
        if r.rows >= last.get(r.experiment_id, r).rows:
            last[r.experiment_id] = r
    for name in ("hot", "good", "swing"):
        state, promoted, ratings = plain_fold(logs[name])
        assert last[name].main_fraction == pytest.approx(state.main)
        assert (last[name].candidate_ratings, last[name].promoted) == (ratings, promoted is not None)

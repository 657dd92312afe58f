"""Point-in-time walks: equal to recomputing every prefix, also for users across slices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import features as ft
from tastemill.operators import history as h
from tastemill.operators import vectors as vc
from tastemill.operators.vectors import VectorSpace

RATING = "user_id bigint, movie_id bigint, rating double, rating_timestamp bigint, id bigint"


def ratings_frame(spark, rows):
    df = spark.createDataFrame(rows, RATING)
    return df.withColumn("rating_timestamp", F.timestamp_seconds("rating_timestamp"))


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 ratings, user 7 holds a third; movie 9 has no vector."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        user = 7 if i % 3 == 0 else int(rng.integers(0, 40))
        rows.append((user, int(rng.integers(0, 10)), float(rng.integers(1, 11)) / 2, int(rng.integers(0, 200)), i))
    return ratings_frame(spark, rows).persist(), rows


@pytest.fixture(scope="module")
def spaces(spark):
    rng = np.random.default_rng(6)
    vectors = {name: {m: rng.normal(size=dim).astype(np.float32) for m in range(9)} for name, dim in (("content", 4), ("cf", 3))}
    frames = []
    for name, dim in (("content", 4), ("cf", 3)):
        data = [(m, [float(x) for x in v]) for m, v in vectors[name].items()]
        frames.append(VectorSpace(name, spark.createDataFrame(data, "movie_id bigint, vector array<float>"), dim))
    return frames, vectors


def prefixes(rows):
    """(row, earlier rows of the same user) in time order."""
    by_user = {}
    for row in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        earlier = by_user.setdefault(row[0], [])
        yield row, list(earlier)
        earlier.append(row)


def profile(earlier, vectors, dim):
    weight = sum(r[2] for r in earlier)
    if weight <= 0:
        return np.zeros(dim)
    return sum((r[2] * vectors.get(r[1], np.zeros(dim)).astype(float) for r in earlier), np.zeros(dim)) / weight


@pytest.mark.parametrize("rows_per_slice", [100_000, 150])
def test_pit_profiles_equal_prefix_recomputation(skewed, spaces, rows_per_slice):
    df, rows = skewed
    frames, vectors = spaces
    found = {r.id: r for r in h.pit_profiles(df, frames, rows_per_slice=rows_per_slice).collect()}
    assert len(found) == len(rows)
    for row, earlier in prefixes(rows):
        got = found[row[4]]
        assert got.prior_count == len(earlier)
        np.testing.assert_allclose(got.content_profile, profile(earlier, vectors["content"], 4), atol=1e-9)
        np.testing.assert_allclose(got.cf_profile, profile(earlier, vectors["cf"], 3), atol=1e-9)


def test_large_vector_tables_take_the_join_path(skewed, spaces, monkeypatch):
    df, _ = skewed
    frames, _ = spaces
    small = {r.id: r.content_profile for r in h.pit_profiles(df, frames, rows_per_slice=150).collect()}
    monkeypatch.setattr(h, "small_enough", lambda space: False)
    monkeypatch.setattr(vc, "small_enough", lambda space: False)
    joined = {r.id: r.content_profile for r in h.pit_profiles(df, frames, rows_per_slice=150).collect()}
    assert small.keys() == joined.keys()
    for key, value in small.items():
        np.testing.assert_allclose(value, joined[key], atol=1e-9)


def test_only_vectors_of_rated_movies_reach_the_tasks(spark, skewed, spaces, monkeypatch):
    df, rows = skewed
    vectors = spaces[0][0].movies
    unrated = spark.range(10_000, 12_000).select(F.col("id").alias("movie_id"), F.array_repeat(F.lit(1.0).cast("float"), 4).alias("vector"))
    space = vc.VectorSpace("content", vectors.select("movie_id", "vector").unionByName(unrated), 4)
    sent, plain = [], h.vector_table
    monkeypatch.setattr(h, "vector_table", lambda s: sent.append(plain(s)) or sent[-1])
    found = h.weighted_profiles(df, [space]).count(), h.pit_profiles(df, [space]).count()
    assert found == (len({r[0] for r in rows}), len(rows))
    assert sent and all(set(t.ids.tolist()) <= {r[1] for r in rows} for t in sent)


def test_tables_sent_to_every_python_worker_are_small(spark):
    movies = spark.range(20_000).select(F.col("id").alias("movie_id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("vector"))
    assert not vc.small_enough(vc.VectorSpace("content", movies, 64))


def test_a_repeated_vector_repeats_no_rating(skewed, spaces, monkeypatch):
    df, rows = skewed
    space = spaces[0][0]
    twice = vc.VectorSpace("content", space.movies.unionByName(space.movies), 4)
    monkeypatch.setattr(h, "small_enough", lambda space: False)
    once = {r.id: r.content_profile for r in h.pit_profiles(df, [space]).collect()}
    found = h.pit_profiles(df, [twice]).collect()
    assert len(found) == len(rows)
    for r in found:
        np.testing.assert_allclose(r.content_profile, once[r.id], atol=1e-9)


@pytest.mark.parametrize("rows_per_slice", [100_000, 150])
def test_pit_behavior_equals_prefix_recomputation(skewed, rows_per_slice):
    df, rows = skewed
    found = {r.id: r for r in h.pit_behavior(df, rows_per_slice=rows_per_slice).collect()}
    for row, earlier in prefixes(rows):
        values = [r[2] for r in earlier]
        got = found[row[4]]
        assert got.num_user_ratings == len(values)
        assert got.num_high_rated_movies == sum(v >= 4.0 for v in values)
        assert got.num_low_rated_movies == sum(v <= 2.0 for v in values)
        assert got.user_avg_rating == pytest.approx(np.mean(values) if values else 0.0)
        assert got.user_rating_std == pytest.approx(np.std(values) if len(values) > 1 else 0.0, abs=1e-7)


@pytest.mark.parametrize("rows_per_slice", [100_000, 150])
def test_weighted_profiles_merge_across_slices(skewed, spaces, rows_per_slice):
    df, rows = skewed
    frames, vectors = spaces
    found = {r.user_id: r for r in h.weighted_profiles(df, frames, rows_per_slice=rows_per_slice).collect()}
    users = {r[0] for r in rows}
    assert set(found) == users
    for user in users:
        mine = [r for r in rows if r[0] == user]
        assert found[user].rating_count == len(mine)
        np.testing.assert_allclose(found[user].content_profile, profile(mine, vectors["content"], 4), atol=1e-9)
        np.testing.assert_allclose(found[user].cf_profile, profile(mine, vectors["cf"], 3), atol=1e-9)


def test_targets_see_only_earlier_ratings(spark, spaces):
    df = ratings_frame(spark, [(1, 1, 3.0, 100, 1), (1, 2, 4.5, 200, 2), (2, 2, 2.0, 250, 4)])
    targets = spark.createDataFrame([(2, "train"), (4, "test")], "id bigint, split string")
    metadata = VectorSpace("metadata", spark.createDataFrame([], "movie_id bigint, vector array<float>"), 5, profiled=False)
    rows = ft.feature_rows(h.mark_targets(df, targets), *spaces[0], metadata)
    found = sorted((r.user_id, r.split, int(r.features[ft.feature_dim(4, 3) - 10])) for r in rows.collect())
    assert found == [(1, "train", 1), (2, "test", 0)]


def test_feature_layout():
    layout = {name: (at, width) for name, at, width in ft.slot_layout()}
    assert ft.feature_dim() == 1356
    assert layout["content_cosine"] == (768, 1)
    assert layout["user_cf_profile"] == (1153, 64)
    assert layout["candidate_metadata"] == (1351, 5)


def test_feature_rows_equal_assembling_by_hand(skewed, spaces):
    df, rows = skewed
    frames, vectors = spaces
    spark = df.sparkSession
    metadata = VectorSpace(
        "metadata", spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4, 0.5])], "movie_id bigint, vector array<double>"),
        5, "double", (0.0, 0.0, 0.25, 0.0, 0.0), profiled=False,
    )
    marked = df.withColumn("split", F.when(F.col("id") % 2 == 0, "train"))
    found = {r.id: r for r in ft.feature_rows(marked, *frames, metadata, kind="double", rows_per_slice=150).collect()}
    assert set(found) == {r[4] for r in rows if r[4] % 2 == 0}
    for row, earlier in prefixes(rows):
        if row[4] % 2:
            continue
        uc, mc = profile(earlier, vectors["content"], 4), vectors["content"].get(row[1], np.zeros(4)).astype(float)
        uf, mf = profile(earlier, vectors["cf"], 3), vectors["cf"].get(row[1], np.zeros(3)).astype(float)

        def cos(a, b):
            scale = np.linalg.norm(a) * np.linalg.norm(b)
            return a @ b / scale if scale else 0.0

        got = np.array(found[row[4]].features)
        meta = [0.1, 0.2, 0.3, 0.4, 0.5] if row[1] == 1 else [0, 0, 0.25, 0, 0]
        want = np.concatenate([uc, mc, [cos(uc, mc)], uc * mc, uf, mf, [cos(uf, mf)], uf * mf])
        np.testing.assert_allclose(got[:-10], want, atol=1e-9)
        np.testing.assert_allclose(got[-5:], meta)
        assert got[-10] == len(earlier)
        assert found[row[4]].missing_content == (row[1] == 9)


def test_behavior_case(spark):
    df = ratings_frame(spark, [(1, i, r, i, i) for i, r in enumerate([5.0, 4.5, 3.0, 2.0, 1.0])])
    row = h.user_behavior(df).first()
    assert (row.num_user_ratings, row.num_high_rated_movies, row.num_low_rated_movies) == (5, 2, 2)
    assert row.user_avg_rating == pytest.approx(3.1)
    assert row.user_rating_std == pytest.approx(1.49666, abs=1e-5)


def test_weighted_profile_case(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "movie_id bigint, vector array<float>")
    df = ratings_frame(spark, [(1, 1, 1.0, 1, 1), (1, 2, 3.0, 2, 2)])
    assert h.weighted_profiles(df, [VectorSpace("content", vectors, 2)]).first().content_profile == [0.75, 0.75]


def test_missing_vector_still_counts_in_the_weight(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "movie_id bigint, vector array<float>")
    df = ratings_frame(spark, [(1, 1, 2.0, 1, 1), (1, 2, 2.0, 2, 2)])
    assert h.weighted_profiles(df, [VectorSpace("content", vectors, 2)]).first().content_profile == [0.5, 0.0]


def test_liked_genres_case(spark):
    catalog = spark.createDataFrame(
        [(1, ["Sci-Fi", "Action"]), (2, ["Sci-Fi", "Thriller"])], "movie_id bigint, genres array<string>"
    )
    df = ratings_frame(spark, [(1, 1, 5.0, 1, 1), (1, 2, 4.5, 2, 2)])
    rows = h.liked_genres(df, catalog, 2).orderBy("genre_rank").collect()
    assert [r.genre for r in rows] == ["Sci-Fi", "Action"]


def test_exclude_list_keeps_the_first_sixty_distinct(spark):
    shown = spark.createDataFrame([(1, [1, 1, *range(2, 100)])], "user_id bigint, shown_movie_ids array<bigint>")
    rated = spark.createDataFrame([(1, 500), (1, 3)], "user_id bigint, movie_id bigint")
    found = {r.movie_id for r in h.exclude_ids(rated, shown).collect()}
    assert found == set(range(1, 61)) | {500}


def test_removed_ratings_are_not_active(spark):
    events = spark.createDataFrame(
        [(1, 1, 10, "rating_created", 4.0, 100), (2, 1, 10, "rating_deleted", None, 200), (3, 1, 11, "rating_created", 2.0, 100),
         (4, 1, 11, "rating_created", 5.0, 100)],
        "id bigint, user_id bigint, movie_id bigint, event_type string, rating double, ts bigint",
    ).withColumn("rating_timestamp", F.timestamp_seconds("ts"))
    rows = h.active_ratings(events).collect()
    assert [(r.movie_id, r.rating, r.id) for r in rows] == [(11, 5.0, 4)]


def test_stats_bounds_default_to_zero(spark):
    train = spark.createDataFrame([(1,)], "movie_id bigint")
    catalog = spark.createDataFrame(
        [], "movie_id bigint, year bigint, runtime bigint, tmdb_popularity double, tmdb_vote_average double, tmdb_vote_count bigint"
    )
    assert set(ft.stats_values(ft.fit_metadata_stats(train, catalog)).values()) == {0.0}


def test_wrong_width_raises(spark):
    row = spark.range(1).select(F.array(F.lit(1.0)).alias("a"))
    a = F.col("a")
    with pytest.raises(Exception, match="user content must have 2 values"):
        row.select(ft.assemble_features(a, a, a, a, a, a, 2, 1)).collect()


def test_cosine_of_zero_vector(spark):
    row = spark.range(1).select(vc.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert row.c == 0.0 and not math.isnan(row.c)


def test_newest_rows_are_limited_before_the_shuffle_without_sort_aggregates(spark):
    rows = spark.range(100).select(
        (F.col("id") % 5).alias("user_id"), (F.col("id") % 3).alias("movie_id"), F.lit(3.0).alias("rating"), F.lit("rating_created").alias("event_type"),
        F.timestamp_seconds(F.col("id") % 7).alias("rating_timestamp"), "id",
    )
    newest = h.latest_ratings(rows)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: (r.rating_timestamp, r.id)):
        expected[r.user_id, r.movie_id] = r.id
    assert {(r.user_id, r.movie_id): r.id for r in newest.collect()} == expected

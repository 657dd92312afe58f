"""Candidate buckets against brute force, title search, list merging and metrics."""

import datetime
import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks import retrieval_queries
from checks.registry import SQL
from tastemill.operators import ranking as rk
from tastemill.operators import retrieval as rt
from tastemill.operators.search import search_titles


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    vectors = {m: rng.normal(size=6) for m in range(60)}
    profiles = {u: rng.normal(size=6) for u in range(25)} | {99: np.zeros(6)}
    # User 0 has already seen most of the catalog.
    excluded = {(0, m) for m in range(45)} | {(u, int(rng.integers(0, 60))) for u in range(1, 25) for _ in range(4)}
    frames = (
        spark.createDataFrame([(u, [float(x) for x in p]) for u, p in profiles.items()], "user_id bigint, content_profile array<double>"),
        spark.createDataFrame([(m, [float(x) for x in v]) for m, v in vectors.items()], "movie_id bigint, vector array<float>"),
        spark.createDataFrame(sorted(excluded), "user_id bigint, movie_id bigint"),
    )
    return vectors, profiles, excluded, frames


def brute(vectors, profiles, excluded, k):
    result = {}
    for user, profile in profiles.items():
        scored = []
        for movie, vector in vectors.items():
            v = vector.astype(np.float32).astype(float)
            length = np.linalg.norm(profile) * np.linalg.norm(v)
            if (user, movie) not in excluded:
                scored.append((-round(profile @ v / length, 9) if length else 0.0, movie))
        result[user] = [m for _, m in sorted(scored)[:k]]
    return result


@pytest.mark.parametrize(("block_bytes", "users_per_block"), [(1 << 28, 2048), (600, 3)])
@pytest.mark.parametrize("depth", [None, "depth"])
def test_knn_is_exact_also_in_blocks(world, block_bytes, users_per_block, depth):
    vectors, profiles, excluded, (asked, *others) = world
    asked = asked.withColumn("depth", F.col("user_id") % 3 + 1)
    rows = rt.knn(asked, *others, 10, depth=depth, block_bytes=block_bytes, users_per_block=users_per_block).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r["rank"])):
        found.setdefault(r.user_id, []).append(r.movie_id)
    plain = brute(vectors, profiles, excluded, 10)
    assert found == {u: movies[: u % 3 + 1] if depth else movies for u, movies in plain.items()}


def test_knn_brings_no_vectors_to_the_driver(world, monkeypatch):
    def refuse(*_):
        raise AssertionError("a table was brought to the driver")

    frame, collected = type(world[3][0]), []
    plain = frame.collect

    def counted(self):
        rows = plain(self)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(frame, "toArrow", refuse)
    monkeypatch.setattr(frame, "collect", counted)
    assert rt.knn(*world[3], 10, block_bytes=600).count() > 0
    assert max(collected) == 1


def test_knn_over_many_steps_with_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(rt, "USERS_PER_STEP", 7)
    rng = np.random.default_rng(8)
    kinds = rng.normal(size=(40, 6))
    vectors = {m: kinds[m % 40] for m in range(700)}
    profiles = {u: rng.normal(size=6) for u in range(30)}
    excluded = {(u, int(m)) for u in profiles for m in rng.integers(0, 700, 50)} | {(3, m) for m in range(695)}
    rows = rt.knn(
        spark.createDataFrame([(u, [float(x) for x in p]) for u, p in profiles.items()], "user_id bigint, content_profile array<double>"),
        spark.createDataFrame([(m, [float(x) for x in v]) for m, v in vectors.items()], "movie_id bigint, vector array<float>"),
        spark.createDataFrame(sorted(excluded), "user_id bigint, movie_id bigint"), 33, block_bytes=5_000, users_per_block=16,
    ).orderBy("user_id", "rank").collect()
    found = {}
    for r in rows:
        found.setdefault(r.user_id, []).append(r.movie_id)
    assert found == brute(vectors, profiles, excluded, 33)


def test_knn_lists_leave_one_task_whole(world):
    plan = rt.knn(*world[3], 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CoGroup" not in plan


def test_tail_sample(spark):
    pool = spark.range(200).select(
        F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("movie_id"), F.lit(0.5).alias("score"), (F.col("id") + 1).alias("rank")
    )
    seeds = spark.createDataFrame([(1, 7)], "user_id bigint, seed bigint")
    rows = rt.bucket(rt.sample_knn_tail(pool, seeds, 150, 5), rt.RANDOM_KNN).collect()
    assert len(rows) == 5 and {r.retrieval_source for r in rows} == {"random_knn"}
    assert all(r.movie_id >= 150 for r in rows)
    again = rt.sample_knn_tail(pool.repartition(3), seeds, 150, 5).collect()
    assert {r.movie_id for r in rows} == {r.movie_id for r in again}


def test_earlier_bucket_wins_and_cap_holds(spark):
    near = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "user_id bigint, movie_id bigint, score double, rank bigint")
    popular = spark.createDataFrame([(1, 10, 99.0, 1), (1, 12, 98.0, 2)], near.schema)
    merged = rt.merge_buckets([rt.bucket(near, rt.KNN), rt.bucket(popular, rt.POPULAR)], 2).orderBy("pool_rank").collect()
    assert [(r.movie_id, r.retrieval_source) for r in merged] == [(10, "knn"), (11, "knn")]


def test_popular_reaches_past_a_users_exclusions(spark):
    catalog = spark.range(100).select(
        F.col("id").alias("movie_id"), F.array(F.lit("Drama")).alias("genres"), (F.lit(1000.0) - F.col("id")).alias("tmdb_popularity"),
        F.lit(500).alias("tmdb_vote_count"), F.lit(7.0).alias("tmdb_vote_average"), (F.col("id") != 95).alias("poster_safe"),
    )
    liked = spark.createDataFrame([(1, "Drama"), (2, "Drama")], "user_id bigint, genre string")
    excluded = spark.range(90).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("movie_id"))
    rows = rt.popular_by_genres(liked, catalog, excluded, 5).collect()
    assert sorted(r.movie_id for r in rows if r.user_id == 1) == [90, 91, 92, 93, 94]
    assert sorted(r.movie_id for r in rows if r.user_id == 2) == [0, 1, 2, 3, 4]


def genre_catalog(spark, count):
    return spark.range(count).select(
        F.col("id").alias("movie_id"), F.array(F.when(F.col("id") % 2 == 0, "Drama").otherwise("War"), F.lit("Any")).alias("genres"),
        F.pmod(F.col("id") * 7, F.lit(31)).cast("double").alias("tmdb_popularity"), F.lit(500).alias("tmdb_vote_count"), F.lit(7.0).alias("tmdb_vote_average"), F.lit(True).alias("poster_safe"),
    )


def plain_random(liked, excluded, seeds, count, n):
    prime, found = 2**31 - 1, {}
    for user, genre in liked:
        for movie in range(count):
            if genre == "Any" or genre == ("War" if movie % 2 else "Drama"):
                mixed = (seeds[user] * 48_271 + movie * 69_621) % prime
                if (user, movie) not in excluded:
                    found.setdefault(user, {})[movie] = mixed * ((mixed * 16_807 + 12_345) % prime) % prime
    return {(u, m, i + 1) for u, own in found.items() for i, (_, m) in enumerate(sorted((d, m) for m, d in own.items())[:n])}


@pytest.mark.parametrize("blocks", [{}, {"users_per_block": 2, "movies_per_block": 70}])
def test_random_draw_orders_all_movies_of_a_users_genres(spark, blocks):
    liked = [(1, "Drama"), (1, "War"), (2, "Drama"), (3, "None"), (4, "Any"), (4, "Drama"), (5, "War"), (6, "Any")]
    seeds = {1: 5, 2: 2**31 - 1, 3: 1, 4: 77, 5: 123_456, 6: 9}
    excluded = {(1, m) for m in range(200)} | {(5, m) for m in range(300)} | {(4, m) for m in range(0, 300, 3)}
    rows = rt.random_by_genres(
        spark.createDataFrame(liked, "user_id bigint, genre string"), genre_catalog(spark, 300),
        spark.createDataFrame(sorted(excluded), "user_id bigint, movie_id bigint"), spark.createDataFrame(list(seeds.items()), "user_id bigint, seed bigint"), 20, **blocks,
    ).collect()
    assert {(r.user_id, r.movie_id, r["rank"]) for r in rows} == plain_random(liked, excluded, seeds, 300, 20)


def test_merged_pool_draws_from_all_movies_of_a_users_genres(spark):
    rng = np.random.default_rng(5)
    catalog, seeds = genre_catalog(spark, 90), {1: 18, 2: 25}
    vectors = spark.createDataFrame([(m, [float(x) for x in rng.normal(size=4)]) for m in range(90)], "movie_id bigint, vector array<float>")
    profiles = spark.createDataFrame([(u, [1.0, 0.5, 0.0, -1.0]) for u in seeds], "user_id bigint, content_profile array<double>")
    liked, excluded = [(1, "Drama"), (2, "Any"), (2, "War")], {(1, m) for m in range(30)}
    pool = rt.candidate_pool(
        profiles, vectors, catalog, spark.createDataFrame(liked, "user_id bigint, genre string"),
        spark.createDataFrame(sorted(excluded), "user_id bigint, movie_id bigint"), spark.createDataFrame(list(seeds.items()), "user_id bigint, seed bigint"),
        rt.RetrievalSizes(knn=3, popular=2, random_genre=9, random_knn=2, knn_pool=4, random_knn_skip=1, max_candidates=50),
    ).collect()
    earlier = {(r.user_id, r.movie_id) for r in pool if r.retrieval_source != "random_genre"}
    drawn = {(u, m) for u, m, _ in plain_random(liked, excluded, seeds, 90, 9)}
    assert {(r.user_id, r.movie_id) for r in pool if r.retrieval_source == "random_genre"} == drawn - earlier


def write_rated_tables(folder, users, movies):
    """Users who like the movies of one colour: the even ones red (even ids), the others blue."""
    rng, at = np.random.default_rng(11), datetime.datetime(2024, 1, 5)
    rated = [(u, 2 * int(m) + u % 2) for u in users for m in rng.choice(movies // 2, 6, replace=False)]
    events = [{"event_id": i, "ts": at, "user_id": u, "event_type": "click", "value": 95.0, "props": f'{{"k": {m}}}'} for i, (u, m) in enumerate(rated)]
    part = [{"p_partkey": m, "p_name": "blue" if m % 2 else "red", "p_brand": "b", "p_type": "t", "p_size": 1, "p_retailprice": 10.0 + m * 7 % 311} for m in range(movies)]
    vectors = pa.array(rng.normal(size=(movies, 64)).tolist(), pa.list_(pa.float32()))
    tables = {"events": pa.Table.from_pylist(events), "part": pa.Table.from_pylist(part), "embeddings": pa.table({"vec_id": range(movies), "embedding": vectors})}
    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return set(rated)


def test_merged_pool_and_its_sql_draw_from_the_whole_catalog(spark, tmp_path):
    users, movies = range(1, 7), 1800
    excluded = write_rated_tables(tmp_path, users, movies)
    for u in users:
        excluded |= {(u, m) for m in list(dict.fromkeys((u * 3 + i * i) % 200 for i in range(90)))[:60]}
    good = [m for m in range(movies) if m * 37 % 1000 >= 100 and m % 101 >= 60 and m % 13]
    spark_rows = [tuple(r) for r in retrieval_queries.merged_pool(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for name in ("events", "part", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    for rows in (spark_rows, con.execute(SQL["merged_pool"]).fetchall()):
        for u in users:
            own = sorted((rank, movie, source) for user, movie, source, rank in rows if user == u)
            earlier = {movie for _, movie, source in own if source != "random_genre"}
            fresh = [m for m in good if m % 2 == u % 2 and (u, m) not in excluded]
            drawn = sorted(fresh, key=lambda m: (int(rt.random_keys(np.int64(u * 7 + 11), np.int64(m))), m))[:75]
            left = [m for m in drawn if m not in earlier][: 300 - len(earlier)]
            assert left and [movie for _, movie, source in own if source == "random_genre"] == left


def test_one_users_exclusions_deepen_nobody_elses_reading(spark):
    lists = rt._genre_lists(genre_catalog(spark, 2000), [F.col("tmdb_popularity").desc(), F.col("movie_id")])
    liked = spark.createDataFrame([(u, "Any") for u in range(20)], "user_id bigint, genre string")
    nothing = spark.createDataFrame([], "user_id bigint, movie_id bigint")
    most = spark.range(1900).select(F.lit(0).cast("bigint").alias("user_id"), F.col("id").alias("movie_id"))
    read = lambda gone: dict(Counter(r.user_id for r in rt._read_lists(liked, lists, gone, 5).collect()))
    assert read(nothing) == {u: 5 for u in range(20)}
    deep = read(most)
    assert 5 <= deep.pop(0) <= 100 and deep == {u: 5 for u in range(1, 20)}
    plan = rt._read_lists(liked, lists, most, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_task_draws_once_per_user_and_movie(spark):
    found = np.array([[2, 5, 30], [1, 7, 10], [1, 7, 10], [1, 8, 10], [2, 4, 20], [1, 9, 5], [2, 6, 10]])
    assert rt._lowest(found, 2).tolist() == [[1, 9, 5], [1, 7, 10], [2, 6, 10], [2, 4, 20]]
    assert rt._lowest(np.zeros((0, 3), np.int64), 2).shape == (0, 3)
    # Users drawing from several genres send n rows, so nothing is left to make distinct.
    liked = spark.createDataFrame([(u, g) for u in range(9) for g in ("Any", "Drama", "War")], "user_id bigint, genre string")
    seeds = spark.createDataFrame([(u, u) for u in range(9)], "user_id bigint, seed bigint")
    nothing = spark.createDataFrame([], "user_id bigint, movie_id bigint")
    plan = rt.random_by_genres(liked, genre_catalog(spark, 300), nothing, seeds, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("FlatMapCoGroups")[0]


def test_popular_movies_of_a_user_are_read_ranked_and_cut_in_one_task(spark):
    liked = spark.createDataFrame([(u, g) for u in range(9) for g in ("Any", "Drama")], "user_id bigint, genre string")
    excluded = spark.range(0, 300, 2).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("movie_id"))
    # A movie that the catalog holds twice takes two places, and both of them are skipped.
    catalog = genre_catalog(spark, 300).unionByName(genre_catalog(spark, 40))
    found = rt.popular_by_genres(liked, catalog, excluded, 60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "Exchange" not in plan.split("arrays_zip")[0].split("BroadcastHashJoin [genre")[0]
    own = sorted((-(m * 7 % 31), m) for m in range(300) if m % 2)
    assert [r.movie_id for r in found.where("user_id = 1").orderBy("rank").collect()] == [m for _, m in own[:60]]


def test_ranks_inside_a_huge_group(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).cast("bigint").alias("user_id"), "id",
        (F.pmod(F.col("id") * 379, F.lit(50)) / 10).alias("score"),
    )
    from tastemill.operators.rank import rank_in_groups

    keyed = rows.withColumn("down", -F.col("score"))
    found = {r.id: r.place for r in rank_in_groups(keyed, "user_id", ["down", "id"], "place", rows_per_slice=150).collect()}
    by_user = {}
    for r in rows.collect():
        by_user.setdefault(r.user_id, []).append((-r.score, r.id))
    assert found == {key[1]: i + 1 for group in by_user.values() for i, key in enumerate(sorted(group))}


def test_no_cartesian_product_in_knn(world):
    plan = rt.knn(*world[3], 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("blocks", [{}, {"queries_per_block": 2, "titles_per_block": 40}])
def test_title_search_equals_plain_bm25(spark, blocks):
    titles = ["the heat", "heat", "the the road", "road to heat city", "city of god", "Heat", "the"] * 30
    movies = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "movie_id bigint, title string").repartition(3)
    queries = {1: "heat", 2: "the city", 3: "nothing here", 4: "the the", 5: "   "}
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, query string")
    rows = search_titles(asked, movies, 7, **blocks).collect()
    docs = [t.lower().split() for t in titles]
    average = sum(map(len, docs)) / len(docs)

    def idf(n):
        return math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))

    for query_id, query in queries.items():
        scores = []
        for i, words in enumerate(docs):
            tf = Counter(words)
            body = sum(
                idf(sum(w in d for d in docs)) * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / average)) for w in query.split() if tf[w]
            )
            exact = idf(titles.count(query)) / 2.2 if titles[i] == query else 0.0
            best = round(max(body, exact), 9)
            if best > 0:
                scores.append((-best, i))
        want = [(i, pytest.approx(-s)) for s, i in sorted(scores)[:7]]
        got = sorted((r for r in rows if r.query_id == query_id), key=lambda r: r["rank"])
        assert [(r.movie_id, r.score) for r in got] == want


def predictions(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, id bigint, rating double, score double")


def test_ranking_metric_case(spark):
    rows = [(1, i, r, s) for i, (r, s) in enumerate(zip([5.0, 1.0, 4.5, 2.0], [0.9, 0.1, 0.8, 0.2], strict=True))]
    found = rk.ranking_metrics(predictions(spark, rows)).first()
    assert (found.precision_at_5, found.precision_at_10, found.recall_at_5, found.mrr_at_10) == (0.4, 0.2, 1.0, 1.0)
    assert found.ndcg_at_5 == pytest.approx(1.0) and found.users_evaluated == 1


def test_users_without_a_list_or_a_hit_are_skipped(spark):
    found = rk.ranking_metrics(predictions(spark, [(1, 1, 5.0, 0.5), (2, 2, 1.0, 0.5), (2, 3, 2.0, 0.4)])).first()
    assert found.users_evaluated == 0 and found.precision_at_5 == 0.0


def test_regression_case(spark):
    rows = spark.createDataFrame([(3.0, 1.0), (4.0, 4.0)], "prediction double, rating double")
    found = rk.regression_metrics(rows).first()
    assert (found.mae, found.rmse, found.rows) == (1.0, pytest.approx(math.sqrt(2)), 2)
    empty = rk.regression_metrics(rows.limit(0)).first()
    assert (empty.mae, empty.rmse, empty.rows) == (0.0, 0.0, 0)


def test_model_merge_keeps_the_higher_score_once(spark):
    ranked = spark.createDataFrame(
        [(1, 7, 4.0, "main", 1), (1, 8, 3.0, "main", 2), (1, 7, 4.5, "candidate", 1), (1, 9, 1.0, "candidate", 2)],
        "user_id bigint, movie_id bigint, predicted_score double, model_role string, rank bigint",
    )
    slots = spark.createDataFrame([(1, 2, 1)], "user_id bigint, main_slots bigint, candidate_slots bigint")
    rows = rk.merge_model_rankings(ranked, slots, 20).orderBy("rank_position").collect()
    assert [(r.movie_id, r.predicted_score, r.model_role) for r in rows] == [(7, 4.5, "candidate"), (8, 3.0, "main")]

"""Datasets on disk and the composite jobs, end to end on the small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import tables as t
from checks.job_queries import fixed_layers
from tastemill.models import factors as fa
from tastemill.models import ranker as ra
from tastemill.operators import features as ft
from tastemill.operators.vectors import VectorSpace
from tastemill.plans import catalog_jobs as cj
from tastemill.plans import dataset_jobs as dj
from tastemill.plans import recommend_jobs as rj
from tastemill.sources import datasets as ds
from tastemill.sources import operational as op
from tastemill.sources.catalog_csv import read_ratings_csv, read_tags_csv

def at(seconds=1_706_745_600):
    return F.timestamp_seconds(F.lit(seconds))


def test_latest_complete_version(spark, tmp_path):
    root = str(tmp_path / "root")
    with pytest.raises(ValueError, match="no complete version"):
        ds.latest_complete(spark, root)
    for version, text in {
        "2024-01-01": '{"version": "2024-01-01", "status": "complete"}',
        "2024-01-02": '{"version": "2024-01-02", "status": "complete"}',
        "2024-01-03": '{"version": "2024-01-03", "status": "running"}',
        "2024-01-04": '{"version": "2024-',
    }.items():
        ds.write_text(spark, f"{root}/version={version}/manifest.json", text)
    assert ds.latest_complete(spark, root) == "2024-01-02"
    assert ds.latest_complete(spark, root, "2024-01-01") == "2024-01-01"
    with pytest.raises(ValueError, match="not complete"):
        ds.latest_complete(spark, root, "2024-01-03")


def test_lineage_mismatch_is_named():
    good = {"snapshot_id": "a", "status": "complete"}
    ds.require_lineage({"snapshot_id": "a"}, ("dataset", good))
    with pytest.raises(ValueError, match="factors: snapshot_id is b, expected a"):
        ds.require_lineage({"snapshot_id": "a"}, ("dataset", good), ("factors", {**good, "snapshot_id": "b"}))
    with pytest.raises(ValueError, match="status"):
        ds.require_lineage({}, ("dataset", {"status": "running"}))


def test_digest_of_files_larger_than_a_chunk(spark, tmp_path):
    import hashlib

    contents = {f"{n}.bin": bytes((i * 7 + n) % 251 for i in range(n)) for n in (1, 999, 1_000, 1_001, 70_003)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    found = {r.path.rsplit("/", 1)[1]: r.sha256 for r in ds.file_digests(listed, chunk_bytes=1_000).collect()}
    assert found == {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_user_gradients_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(int(u), int(m), float(np.float32(rng.uniform(0.5, 5)))) for u in range(12) for m in rng.choice(20, 1 + u, replace=False)] + [(3, 4, 2.0)] * 3
    train = spark.createDataFrame(rows, "user_idx int, movie_idx int, rating double")
    model = fa.fit_factors(train, rank=4, iterations=3)
    found = {r.user_idx: r for r in fa.user_gradients(model, train).collect()}
    movies = {r.id: np.array(r.features, float) for r in model.itemFactors.collect()}
    for user in range(12):
        own = [(movies[m], r) for u, m, r in rows if u == user]
        v, r = np.array([x for x, _ in own]), np.array([y for _, y in own])
        best = np.linalg.solve(v.T @ v + fa.REGULARISATION * len(r) * np.eye(4), v.T @ r)
        fitted = next(np.array(x.features, float) for x in model.userFactors.collect() if x.id == user)
        assert np.allclose(best, fitted, atol=1e-4)
        assert found[user].ratings == len(r) and found[user].gradient <= 1e-3 * (found[user].scale + 1e-3)
    wrong = fa.user_gradients(model, train.withColumn("rating", F.col("rating") + 1))
    assert wrong.where(F.col("gradient") > 0.01 * F.col("scale")).count() == 12


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash of the hashing encoder, as a signed integer."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    whole = len(data) // 4 * 4
    blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)]
    mixed = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    for k in blocks:
        h = (turn(h ^ mixed(k), 13) * 5 + 0xE6546B64) & mask
    if tail := data[whole:]:
        h ^= mixed(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_values_of_the_hashing_encoder(spark, sf):
    import numpy as np

    from tastemill.models.encoder import embed_stale
    from tastemill.operators.search import tokens

    texts = t.load(spark, sf, "documents").select(F.col("doc_id").alias("movie_id"), "text")
    stored = spark.createDataFrame([], "movie_id bigint, embedding array<float>, embedding_text_hash string")
    fresh = {r.movie_id: r.embedding for r in embed_stale(texts, stored, 32, "v1").collect()}
    rows = texts.select("movie_id", tokens(F.col("text")).alias("words")).collect()
    assert len(fresh) == len(rows)
    for row in rows:
        counts = np.zeros(32)
        for word in row.words:
            counts[murmur3(word.encode()) % 32] += 1
        assert np.allclose(fresh[row.movie_id], counts / max(np.linalg.norm(counts), 1e-12), atol=1e-6)


def test_ordered_export_and_inventory(spark, sf, tmp_path):
    import hashlib
    from pathlib import Path

    rows = t.ratings(spark, sf)
    ds.export_ordered(rows, str(tmp_path / "out"), ["rating_timestamp", "id"], 90)
    found = ds.part_inventory(spark, str(tmp_path / "out")).collect()
    files = {str(p): p for p in Path(tmp_path / "out").glob("*.parquet")}
    assert sum(r.row_count for r in found) == rows.count() and max(r.row_count for r in found) <= 90
    assert len(found) == len(files)
    for r in found:
        assert r.sha256 == hashlib.sha256(files[r.object_key.replace("file://", "").replace("file:", "")].read_bytes()).hexdigest()
    spans = []
    for path in files:
        part = spark.read.parquet(path).select("rating_timestamp", "id").collect()
        assert part == sorted(part)
        spans.append((part[0], part[-1]))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.fixture(scope="module")
def pipeline(spark, sf, tmp_path_factory):
    """Snapshot, training dataset, factors and features of the small tables."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    content = t.content_vectors(spark, sf).select(
        "movie_id", F.lit("v1").alias("embedding_version"), F.col("vector").alias("embedding")
    )
    tables = {
        "ratings_events": t.ratings(spark, sf), "tag_events": t.tags(spark, sf), "catalog_movies": t.catalog(spark, sf),
        "movie_content_embeddings": content,
    }
    paths = {n: f"{root}/{n}" for n in ("snapshots", "datasets", "factors", "features", "models")}
    shot = dj.snapshot(spark, tables, paths["snapshots"], "s1", 300)
    dataset = dj.prepare_training(spark, paths["snapshots"], paths["datasets"], "d1", mode="created", part_rows=200)
    train = dj.read_split(spark, paths["datasets"], "d1", "train")
    model = fa.fit_factors(train, rank=8, iterations=3)
    movie_map = spark.read.parquet(f"{paths['datasets']}/version=d1/movie_id_map")
    factors = fa.movie_factors(model, movie_map)
    dj.write_movie_factors(factors, paths["factors"], "f1", {"snapshot_id": "s1", "cf_dataset_version": "d1"})
    features = dj.create_features(
        spark, paths["snapshots"], paths["datasets"], paths["factors"], paths["features"], "x1", content_dim=64, cf_dim=8, part_rows=300
    )
    return paths, shot, dataset, model, features


def test_snapshot_counts(spark, sf, pipeline):
    _, shot, *_ = pipeline
    assert shot["tables"]["ratings_events"]["row_count"] == t.ratings(spark, sf).count()
    assert shot["tables"]["ratings_events"]["part_count"] >= 4


def test_training_dataset(spark, sf, pipeline):
    paths, _, dataset, model, _ = pipeline
    total = t.created(spark, sf).count()
    assert sum(s["total_rows"] for s in dataset["splits"].values()) == total
    assert dataset["splits"]["train"]["total_rows"] == int(total * 0.8)
    train = dj.read_split(spark, paths["datasets"], "d1", "train")
    sizes = {r.part_idx: r["count"] for r in train.groupBy("part_idx").count().collect()}
    rows = dataset["splits"]["train"]["mapped_rows"]
    assert sizes == {i: min(200, rows - 200 * i) for i in range(-(-rows // 200))}
    assert ds.load_manifest(spark, paths["datasets"], "d1")["num_users"] == train.select("user_id").distinct().count()
    assert model.rank == 8


def test_movie_factors_cover_the_catalog(spark, sf, pipeline):
    paths, *_ = pipeline
    factors = spark.read.parquet(f"{paths['factors']}/version=f1/movie_factors")
    assert factors.count() == t.catalog(spark, sf).count()
    assert factors.where(F.size("cf_embedding") == 8).count() == factors.count()
    assert factors.where(F.forall("cf_embedding", lambda x: x == 0)).count() > 0


def test_features_have_one_row_per_mapped_rating(spark, pipeline):
    paths, _, dataset, _, features = pipeline
    rows = spark.read.parquet(f"{paths['features']}/version=x1/features")
    want = sum(s["mapped_rows"] for s in dataset["splits"].values())
    assert features["quality"]["rows"] == rows.count() == want
    assert features["quality"]["row_count_delta"] == 0
    assert features["input_dim"] == 3 * 64 + 3 * 8 + 12
    assert rows.where(F.size("features") != features["input_dim"]).count() == 0
    assert rows.where(F.exists("features", lambda x: F.isnan(x))).count() == 0


def test_rank_and_evaluate(spark, pipeline):
    paths, *_ = pipeline
    rows = spark.read.parquet(f"{paths['features']}/version=x1/features")
    layers = ra.fit_linear(rows.where("split = 'train'"))
    report = dj.evaluate(spark, paths["features"], layers, paths["models"], "m1")
    assert 0 < report["test_rmse"] < 3 and report["num_test_rows"] == rows.where("split = 'test'").count()
    assert ds.load_manifest(spark, paths["models"], "m1")["test_rmse"] == report["test_rmse"]
    trees = ra.fit_trees(rows.where("split = 'train'").limit(300), iterations=2, depth=2)
    assert ra.score_trees(trees, rows.limit(5)).select("prediction").count() == 5
    with pytest.raises(ValueError, match="input_dim"):
        dj.evaluate(spark, paths["features"], fixed_layers(10, 2), paths["models"], "m2")


@pytest.mark.parametrize("field", ["dataset_version", "cf_version", "feature_schema_version", "input_dim", None])
def test_evaluate_checks_what_the_model_was_trained_on(spark, pipeline, field):
    paths = pipeline[0]
    manifest = ds.load_manifest(spark, paths["features"], "x1")
    model = {"dataset_version": "x1", **{f: manifest[f] for f in ("cf_version", "feature_schema_version", "input_dim")}}
    layers = ra.fit_linear(spark.read.parquet(f"{paths['features']}/version=x1/features").where("split = 'train'"))
    if field is None:
        report = dj.evaluate(spark, paths["features"], layers, paths["models"], "m4", model=model)
        assert report["model"] == model and report["dataset_version"] == "x1"
        return
    with pytest.raises(ValueError, match=field if field != "dataset_version" else "version"):
        dj.evaluate(spark, paths["features"], layers, paths["models"], "m5", dataset_version="x1", model={**model, field: "other"})


def test_lineage_guards_features(spark, pipeline):
    paths, *_ = pipeline
    dj.write_movie_factors(
        spark.read.parquet(f"{paths['factors']}/version=f1/movie_factors"), paths["factors"], "f0", {"snapshot_id": "other", "cf_dataset_version": "d1"}
    )
    with pytest.raises(ValueError, match="factors: snapshot_id"):
        dj.create_features(
            spark, paths["snapshots"], paths["datasets"], paths["factors"], paths["features"], "x9", factors_version="f0", content_dim=64, cf_dim=8
        )


def test_best_model_stops_without_progress(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,)], "rating double")
    tried = []

    def fit(setting):
        tried.append(setting["guess"])
        return setting["guess"]

    best, setting, history = fa.select_best(
        [{"guess": g} for g in (3.0, 1.5, 0.0, 5.0, 1.4)], fit, lambda m, df: df.withColumn("prediction", F.lit(m)), rows
    )
    assert best == 1.5 and setting == {"guess": 1.5} and tried == [3.0, 1.5, 0.0, 5.0] and len(history) == 4


def test_recommendations_match_a_plain_scoring(spark, sf):
    stats = ft.stats_values(ft.fit_metadata_stats(t.created(spark, sf), t.catalog(spark, sf)))
    content, cf = t.content_space(spark, sf), t.cf_space(spark, sf)
    layers = fixed_layers(ft.feature_dim(64, 64), 5)
    main = rj.RankingModel("m1", layers, cf)
    args = (t.ratings(spark, sf), t.catalog(spark, sf), content, stats, main, at())
    rows = rj.recommend_batch(*args, experiment_id="e", top_k=10).collect()
    ratings = rj.eligible_ratings(t.ratings(spark, sf), t.catalog(spark, sf))
    seen = {(r.user_id, r.movie_id) for r in ratings.collect()}
    users = {u for u, _ in seen}
    by_user = {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append(r)
        assert (r.user_id, r.movie_id) not in seen
    assert set(by_user) == users
    safe = {r.movie_id for r in t.catalog(spark, sf).where("poster_safe").collect()}
    for listed in by_user.values():
        listed.sort(key=lambda r: r.rank_position)
        assert [r.rank_position for r in listed] == list(range(1, len(listed) + 1)) and len(listed) == 10
        scores = [r.predicted_score for r in listed]
        assert scores == sorted(scores, reverse=True) and len({r.movie_id for r in listed}) == 10
        assert {r.movie_id for r in listed} <= safe and len({r.request_id for r in listed}) == 1
    # One user's list again with the column form of the feature vector.
    user = min(users)
    inputs = rj.user_inputs(ratings.where(F.col("user_id") == user), content, cf)
    cat = t.catalog(spark, sf).join(content.movies, "movie_id").join(cf.movies.select("movie_id", F.col("vector").alias("cf")), "movie_id", "left")
    features = ft.assemble_features(
        F.col("content_profile"), F.col("vector").cast("array<double>"), F.col("cf_profile"),
        F.coalesce(F.col("cf").cast("array<double>"), F.array_repeat(F.lit(0.0), 64)), F.col("behavior"),
        F.array(*ft.normalized_metadata(stats)), 64, 64,
    )
    joined = cat.join(F.broadcast(inputs), F.lit(user) == F.col("user_id")).select("movie_id", features.alias("features"))
    scored = {r.movie_id: r.prediction for r in ra.score_layers(joined, layers).collect()}
    for r in by_user[user]:
        assert r.predicted_score == pytest.approx(scored[r.movie_id], abs=1e-5)


def scoring_world(spark, repeated=()):
    rng = np.random.default_rng(4)
    draw = lambda ids, width: {i: rng.normal(size=width).astype(np.float32).astype(float) for i in ids}
    content, cf, metadata = draw(range(60), 4), draw(range(20, 80), 3), draw(range(70), 5)
    inputs = {u: (rng.normal(size=4), rng.normal(size=3), rng.normal(size=5)) for u in range(40)}
    pool = [(u, int(m), i + 1, "knn" if i % 2 else "popular") for u in range(-1, 40) for i, m in enumerate(rng.choice(80, 9, replace=False))]
    layers = [(rng.normal(size=(33, 3)), np.zeros(3)), (rng.normal(size=(3, 1)), np.ones(1))]
    rows = lambda vectors: [(m, v.tolist()) for m, v in vectors.items()] + [(m, vectors[m].tolist()) for m in repeated if m in vectors]
    space = lambda name, vectors, dim, kind: VectorSpace(
        name, spark.createDataFrame(rows(vectors), f"movie_id bigint, vector array<{kind}>"), dim, kind)
    spaces = space("content", content, 4, "float"), space("cf", cf, 3, "float"), space("metadata", metadata, 5, "double")
    frames = (
        spark.createDataFrame(pool, "user_id bigint, movie_id bigint, pool_rank bigint, retrieval_source string"),
        spark.createDataFrame([(u, *(x.tolist() for x in own)) for u, own in inputs.items()], "user_id bigint, content_profile array<double>, cf_profile array<double>, behavior array<double>"),
    )
    plain = {}
    for user, movie, rank, source in pool:
        if user in inputs:
            own = inputs[user]
            found = [space.get(movie, np.zeros(n))[None] for space, n in ((content, 4), (cf, 3), (metadata, 5))]
            matrix = ft.assemble_matrix(own[0][None], found[0], own[1][None], found[1], own[2][None], found[2])
            plain[user, movie] = (rank, source, ra.forward(matrix, layers)[0])
    return frames, spaces, layers, plain


@pytest.mark.parametrize("large", [(), ("content", "cf"), ("metadata",), ("content", "cf", "metadata")])
@pytest.mark.parametrize("blocks", [{}, {"rows_per_block": 40, "users_per_block": 7, "movies_per_block": 11}])
def test_pool_scores_in_blocks_of_users_and_movies(spark, monkeypatch, large, blocks):
    monkeypatch.setattr(rj, "small_enough", lambda space: space.name not in large)
    frames, spaces, layers, plain = scoring_world(spark)
    models = {"main": rj.RankingModel("m1", layers, spaces[1]), "candidate": rj.RankingModel("c1", [(-w, b) for w, b in layers], spaces[1])}
    scored = rj.score_pool(*frames, *spaces, models, **blocks)
    # Candidates travel as ids: no row packs their vectors.
    assert "collect_list" not in scored._jdf.queryExecution().executedPlan().toString()
    rows = scored.collect()
    assert len(rows) == 2 * len(plain) and {r.model_version for r in rows if r.model_role == "candidate"} == {"c1"}
    main = {(r.user_id, r.movie_id): (r.pool_rank, r.retrieval_source, r.predicted_score) for r in rows if r.model_role == "main"}
    assert main.keys() == plain.keys()
    for key, (rank, source, score) in plain.items():
        assert main[key] == (rank, source, pytest.approx(score, abs=1e-9))
    # Those cut early are behind enough others: ranking what is left gives the same lists.
    cut = rj.score_pool(*frames, *spaces, models, best=2, **blocks)
    listed = lambda rows: {(r.user_id, r.model_role, r["rank"], r.movie_id) for r in rj._ranked(rows, 2).collect()}
    assert listed(cut) == listed(scored)


def test_rows_ahead_of_the_others():
    users, ranks = np.array([7, 7, 7, 7, 3, 3, 9]), np.array([4, 3, 2, 1, 1, 2, 1])
    scores = np.array([1.0, 2.0, np.nan, 2.0, -1.0, -np.inf, np.inf])
    assert rj._ahead(users, scores, ranks, 2).tolist() == [4, 5, 2, 3, 6]
    assert rj._ahead(users[:0], scores[:0], ranks[:0], 2).tolist() == []


def test_a_repeated_vector_repeats_its_candidates_as_a_join_does(spark, monkeypatch):
    monkeypatch.setattr(rj, "small_enough", lambda space: False)
    frames, spaces, layers, plain = scoring_world(spark, repeated=(30,))
    rows = rj.score_pool(*frames, *spaces, {"main": rj.RankingModel("m1", layers, spaces[1])}).collect()
    assert len(rows) == len(plain) + 7 * sum(movie == 30 for _, movie in plain)


def test_score_grid_copies_the_fewest_bytes():
    assert rj._grid(1, 1000, 1000, 1, 1) == (1, 1)
    # Few movies: they go to every block of users, and no user is written twice.
    assert rj._grid(80, 500_000_000, 1_000_000, 9, 1) == (80, 1)
    assert rj._grid(80, 500_000_000, 0, 9, 0) == (80, 1)
    users, movies = rj._grid(78, 575_000_000, 250_000_000, 9, 4)
    assert users * movies >= 78 and users >= 9 and movies >= 4
    assert 575 * movies + 250 * users < 8_000


def test_two_models_share_the_slots(spark, sf):
    stats = ft.stats_values(ft.fit_metadata_stats(t.created(spark, sf), t.catalog(spark, sf)))
    cf = t.cf_space(spark, sf)
    main = rj.RankingModel("m1", fixed_layers(ft.feature_dim(64, 64), 5), cf)
    other = rj.RankingModel("c1", fixed_layers(ft.feature_dim(64, 64), 9), cf)
    shown = t.created(spark, sf).select("user_id").distinct().withColumn("shown_movie_ids", F.array(*[F.lit(i).cast("bigint") for i in (100, 101)]))
    new = spark.createDataFrame([(1, 2, 5.0, 1)], "user_id bigint, movie_id bigint, rating double, id bigint").withColumn("rating_timestamp", at())
    rows = rj.recommend_batch(
        t.ratings(spark, sf), t.catalog(spark, sf), t.content_space(spark, sf), stats, main, at(), candidate=other, candidate_fraction=0.3,
        experiment_id="e", shown=shown, new_ratings=new, token="again", top_k=20,
    ).collect()
    assert not {r.movie_id for r in rows} & {100, 101}
    by_user = {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append(r.model_role)
    assert all(len(roles) <= 20 and roles.count("candidate") <= 6 and roles.count("main") <= 14 for roles in by_user.values())
    assert any("candidate" in roles for roles in by_user.values())


# ---------------------------------------------------------------- catalog jobs


def empty_catalog(spark, sf):
    return t.catalog(spark, sf).withColumns(
        {"enriched_at": F.lit(None).cast("timestamp"), "poster_checked_at": F.lit(None).cast("timestamp")}
    ).limit(0)


def empty_queue(spark, sf):
    return t.dirty_queue(spark, sf).limit(0)


def test_seed_enrich_sync_and_posters(spark, sf, tmp_path):
    (tmp_path / "movies.csv").write_text(
        'movieId,title,genres\n1,"Toy Story, The (1995)",Adventure|Comedy\n2,Heat (1995),(no genres listed)\n3,Alien,Horror\n4,Gone (2000),Drama\n'
    )
    (tmp_path / "links.csv").write_text("movieId,imdbId,tmdbId\n1,0114709,862\n2,113277,949\n3,0078748,\n9,1,1\n4,5,404\n")
    catalog = cj.seed_catalog(spark, str(tmp_path / "movies.csv"), str(tmp_path / "links.csv"), empty_catalog(spark, sf), at()).persist()
    rows = {r.movie_id: r for r in catalog.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1].title, rows[1].year, rows[1].genres, rows[1].imdb_id) == ("Toy Story, The", 1995, ["Adventure", "Comedy"], "tt0114709")
    assert rows[2].genres is None and rows[3].tmdb_id is None and rows[3].poster_safe is True

    payload = {"overview": "Toys", "adult": False, "poster_path": "/t.jpg", "vote_count": 5, "release_dates": {"results": [
        {"iso_3166_1": "US", "release_dates": [{"certification": "R"}]}]}}
    payloads = spark.createDataFrame([(862, json.dumps(payload)), (949, "{broken")], "tmdb_id bigint, payload string")
    change = cj.enrich_catalog(catalog, empty_queue(spark, sf), payloads, at())
    rows = {r.movie_id: r for r in change.catalog.collect()}
    assert (rows[1].enrichment_status, rows[1].overview, rows[1].certification_us) == ("enriched", "Toys", "R")
    assert (rows[2].enrichment_status, rows[2].enrichment_last_error) == ("failed", "parse_error")
    assert rows[3].enrichment_status == "skipped" and rows[4].enrichment_last_error == "not_found"
    assert [r.movie_id for r in change.dirty.collect()] == [1]
    assert change.summary.first().asDict() == {"processed": 1, "failed": 2}

    verdicts = spark.createDataFrame([(1, {"sexual": True}, {"sexual": 0.9})], "movie_id bigint, categories map<string,boolean>, category_scores map<string,double>")
    posters = cj.check_posters(change.catalog, change.dirty, verdicts, at())
    rows = {r.movie_id: r for r in posters.catalog.collect()}
    assert (rows[1].poster_checked, rows[1].poster_safe) == (True, False)
    assert posters.summary.first().hidden_count == 1

    counts = spark.createDataFrame([(1, "fun", 3), (1, "toys", 5)], "movie_id bigint, tag string, count bigint")
    stored = spark.createDataFrame([], "movie_id bigint, embedding_version string, embedding array<float>, embedding_text_hash string, generated_at timestamp")
    root = str(tmp_path / "documents")
    done = cj.sync_documents(posters.catalog, posters.dirty, counts, stored, root, "001", 16, at(), embedding_version="v1")
    assert [(r.movie_id, r.succeeded) for r in done.outcomes.collect()] == [(1, True)]
    assert done.dirty.count() == 0
    row = done.embeddings.first()
    assert np.linalg.norm(row.embedding) == pytest.approx(1.0, abs=1e-5)
    document = json.loads(ds.read_current(spark, root, op.DOCUMENT_SCHEMA).first().document)
    assert document["tags"] == ["toys", "fun"] and document["show_poster"] is False and len(document["content_embedding"]) == 16

    # An unchanged text keeps its embedding; a rebuild publishes the whole catalog.
    later = at(1_806_745_600)
    again = cj.sync_documents(posters.catalog, done.dirty, counts, done.embeddings, root, "002", 16, later, embedding_version="v2", rebuild=True)
    versions = {r.movie_id: r.embedding_version for r in again.embeddings.collect()}
    assert versions == {1: "v1", 2: "v2", 3: "v2", 4: "v2"}
    assert ds.read_current(spark, root, op.DOCUMENT_SCHEMA).count() == 4


def test_failed_documents_stay_in_the_queue(spark, sf, tmp_path):
    docs = spark.createDataFrame([(1, "a", [1.0]), (2, "", [1.0]), (3, "c", [1.0, 2.0])], "movie_id bigint, title string, content_embedding array<float>")
    outcomes = op.publish_documents(docs, str(tmp_path / "d"), "1", 1, at())
    assert {r.movie_id: r.error for r in outcomes.collect()} == {1: None, 2: "title is missing", 3: "embedding has the wrong width"}


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert op.pipeline_runs(spark, path).count() == 0
    op.log_run(spark, path, "r1", "snapshot", "running")
    op.log_run(spark, path, "r1", "snapshot", "success", records_processed=7)
    op.log_run(spark, path, "r2", "snapshot", "running")
    rows = {r.run_id: r for r in op.pipeline_runs(spark, path).collect()}
    assert (rows["r1"].status, rows["r1"].records_processed) == ("success", 7)
    assert rows["r1"].started_at <= rows["r1"].finished_at and rows["r2"].finished_at is None


def test_csv_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,1000\n")
    (tmp_path / "t.csv").write_text('userId,movieId,tag,timestamp\n1,2,"slow, but ""good""",1000\n')
    assert read_ratings_csv(spark, str(tmp_path / "r.csv")).first().rating == 3.5
    assert read_tags_csv(spark, str(tmp_path / "t.csv")).first().tag == 'slow, but "good"'


def test_workers_find_the_package_from_any_directory(tmp_path):
    """A plain session started elsewhere, with the repository only on the driver's import path."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(repo)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from __spark_entry__ import queries\n"
        "print('rows', queries()['mlp_scores'](spark, '/root/testdata/sf0.001').count())\n"
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "rows 500" in done.stdout, done.stderr[-2000:]

"""Dataset jobs: snapshot, training dataset, features, evaluation. Each publishes one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.models.ranker import Layers, score_layers
from tastemill.operators import features as ft
from tastemill.operators import history as h
from tastemill.operators import rank as rk
from tastemill.operators.ranking import METRICS, ranking_metrics, regression_metrics
from tastemill.operators.vectors import VectorSpace, drop_bad_vectors
from tastemill.session import staged
from tastemill.sources import datasets as ds

TIME_ORDERED = {"ratings_events": ["rating_timestamp", "id"], "tag_events": ["id"]}
KEYED = {"catalog_movies": ["movie_id"], "movie_content_embeddings": ["movie_id"]}


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str, part_rows: int = 50_000) -> dict:
    """Export tables in key order and publish counts; checksums go to a table beside the data."""
    base = f"{root}/version={version}"
    summary = {}
    for name, df in tables.items():
        path = f"{base}/{name}"
        ds.export_ordered(df, path, {**TIME_ORDERED, **KEYED}[name], part_rows)
        ds.part_inventory(spark, path).write.mode("overwrite").parquet(f"{base}/_parts/{name}")
        parts = spark.read.parquet(f"{base}/_parts/{name}").agg(F.sum("row_count"), F.count(F.lit(1))).first()
        summary[name] = {"prefix": path, "row_count": parts[0] or 0, "part_count": parts[1]}
    details = {"snapshot_id": version, "tables": summary}
    ds.commit_dataset(spark, root, version, details)
    return details


def prepare_training(
    spark: SparkSession,
    snapshots: str,
    root: str,
    version: str,
    *,
    snapshot_id: str | None = None,
    mode: str = "raw",
    train: float = 0.8,
    validation: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    part_rows: int = 500_000,
) -> dict:
    """Time split, dense id maps, shuffled training parts. Ids and times stay in the parts."""
    rk.check_fractions(train, validation, test)
    chosen = ds.latest_complete(spark, snapshots, snapshot_id)
    events = h.select_ratings(ds.read_snapshot(spark, snapshots, chosen, "ratings_events"), mode)
    ratings = events.select("id", "user_id", "movie_id", "rating", "rating_timestamp")
    catalog = ds.read_snapshot(spark, snapshots, chosen, "catalog_movies").select("movie_id")
    base = f"{root}/version={version}"
    split = rk.temporal_split(ratings, train, validation)
    maps = {
        "user_id_map": rk.dense_index(split.where(F.col("split") == "train"), "user_id", "user_idx"),
        "movie_id_map": rk.dense_index(catalog, "movie_id", "movie_idx"),
    }
    for name, df in maps.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    users, movies = (spark.read.parquet(f"{base}/{name}") for name in maps)
    # Numbering reads the rows several times, so the joins run once, into a staging copy by split.
    mapped = staged(rk.map_to_indexes(split, users, movies), "split")
    for name in ("train", "validation", "test"):
        rows = mapped.where(F.col("split") == name).drop("split")
        if name == "train":
            rows = rows.withColumn("shuffle_key", rk.shuffle_key(seed))
            parts = rk.number_parts(rows, ["shuffle_key", "id"], part_rows).drop("shuffle_key")
        else:
            parts = rk.number_parts(rows, ["rating_timestamp", "id"], part_rows)
        ds.write_numbered_parts(parts, f"{base}/{name}")
    kept = {r["split"]: r["count"] for r in mapped.groupBy("split").count().collect()}
    total = ratings.count()
    ends = rk.split_rows(total, train, validation)
    sizes = {"train": ends[0], "validation": ends[1] - ends[0], "test": total - ends[1]}
    details = {
        "snapshot_id": chosen,
        "cf_dataset_version": version,
        "num_users": users.count(),
        "num_movies": movies.count(),
        "fractions": {"train": train, "validation": validation, "test": test},
        "shuffle_seed": seed,
        "rating_mode": mode,
        "splits": {
            n: {"total_rows": size, "mapped_rows": kept.get(n, 0), "dropped_rows": size - kept.get(n, 0)} for n, size in sizes.items()
        },
    }
    ds.commit_dataset(spark, root, version, details)
    return details


def read_split(spark: SparkSession, root: str, version: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}/{split}")


def create_features(
    spark: SparkSession,
    snapshots: str,
    datasets: str,
    factors: str,
    root: str,
    version: str,
    *,
    dataset_version: str | None = None,
    factors_version: str | None = None,
    content_dim: int = ft.CONTENT_DIM,
    cf_dim: int = ft.CF_DIM,
    embedding_version: str | None = None,
    part_rows: int = 100_000,
) -> dict:
    """Point-in-time feature rows of every mapped rating, written by split."""
    dataset_version = ds.latest_complete(spark, datasets, dataset_version)
    factors_version = ds.latest_complete(spark, factors, factors_version)
    dataset = ds.load_manifest(spark, datasets, dataset_version)
    chosen = dataset["snapshot_id"]
    ds.require_lineage(
        {"snapshot_id": chosen, "cf_dataset_version": dataset_version},
        ("snapshot", ds.load_manifest(spark, snapshots, chosen)),
        ("dataset", dataset),
        ("factors", ds.load_manifest(spark, factors, factors_version)),
    )
    events = ds.read_snapshot(spark, snapshots, chosen, "ratings_events")
    ratings = events.where(F.col("rating").isNotNull()).select("id", "user_id", "movie_id", "rating", "rating_timestamp")
    catalog = ds.read_snapshot(spark, snapshots, chosen, "catalog_movies")
    stored = ds.read_snapshot(spark, snapshots, chosen, "movie_content_embeddings")
    if embedding_version is not None:
        stored = stored.where(F.col("embedding_version") == embedding_version)
    content = drop_bad_vectors(stored.select("movie_id", F.col("embedding").alias("vector")), content_dim)
    learned = spark.read.parquet(f"{factors}/version={factors_version}/movie_factors")
    cf = learned.select("movie_id", F.col("cf_embedding").alias("vector"))
    targets = [
        read_split(spark, datasets, dataset_version, name).select(F.lit(name).alias("split"), "id", "user_id", "movie_id")
        for name in ("train", "validation", "test")
    ]
    candidates = targets[0].unionByName(targets[1]).unionByName(targets[2])
    stats = ft.stats_values(ft.fit_metadata_stats(targets[0], catalog))
    history = h.of_users(ratings, h.candidate_users(candidates))
    rows = ft.feature_rows(
        staged(h.mark_targets(history, candidates)),
        VectorSpace("content", content, content_dim),
        VectorSpace("cf", cf, cf_dim),
        ft.metadata_space(catalog, stats),
    )
    base = f"{root}/version={version}"
    ds.write_feature_parts(rows, f"{base}/features", part_rows)
    written = spark.read.parquet(f"{base}/features")
    quality = ft.feature_quality(written, candidates.count(), candidates, part_rows).first().asDict()
    details = {
        "snapshot_id": chosen,
        "cf_dataset_version": dataset_version,
        "cf_version": factors_version,
        "dataset_version": version,
        "feature_schema_version": ft.FEATURE_SCHEMA_VERSION,
        "input_dim": ft.feature_dim(content_dim, cf_dim),
        "normalization": stats,
        "quality": quality,
    }
    ds.commit_dataset(spark, root, version, details)
    return details


def evaluate(
    spark: SparkSession,
    features_root: str,
    layers: Layers,
    root: str,
    version: str,
    *,
    dataset_version: str | None = None,
    split: str = "test",
    input_dim: int | None = None,
    model: dict | None = None,
) -> dict:
    """Score a held-out split once, then error and ranking metrics.

    `model` is the lineage that the model was trained with: dataset_version, cf_version,
    feature_schema_version and input_dim. Without a `dataset_version` its dataset is taken; a
    field that disagrees with the dataset raises.
    """
    model = model or {}
    dataset_version = ds.latest_complete(spark, features_root, dataset_version or model.get("dataset_version"))
    manifest = ds.load_manifest(spark, features_root, dataset_version)
    width = layers[0][0].shape[0] if input_dim is None else input_dim
    ds.require_lineage(
        {"feature_schema_version": ft.FEATURE_SCHEMA_VERSION, "input_dim": width}, ("features", manifest)
    )
    fields = ("cf_version", "feature_schema_version", "input_dim")
    trained_on = {"dataset_version": dataset_version, **{f: manifest[f] for f in fields if f in manifest}}
    ds.require_lineage(trained_on, ("model", {"status": ds.COMPLETE, **model}))
    held_out = spark.read.parquet(f"{features_root}/version={dataset_version}/features").where(F.col("split") == split)
    base = f"{root}/version={version}"
    scored = score_layers(held_out.select("id", "user_id", "movie_id", "rating", "features"), layers)
    scored.drop("features").write.mode("overwrite").parquet(f"{base}/predictions")
    predictions = spark.read.parquet(f"{base}/predictions")
    errors = regression_metrics(predictions).first().asDict()
    ranks = ranking_metrics(predictions, score="prediction").first().asDict()
    details = {
        "dataset_version": dataset_version,
        **({"model": model} if model else {}),
        "test_rmse": errors["rmse"],
        "test_mae": errors["mae"],
        "num_test_rows": errors["rows"],
        **{m: ranks[m] for m in METRICS},
        "num_users_evaluated": ranks["users_evaluated"],
    }
    ds.commit_dataset(spark, root, version, details)
    return details


def write_movie_factors(factors: DataFrame, root: str, version: str, details: dict) -> None:
    """Publish (movie_id, cf_embedding) of a trained model."""
    factors.write.mode("overwrite").parquet(f"{root}/version={version}/movie_factors")
    ds.commit_dataset(factors.sparkSession, root, version, {"cf_version": version, **details})

"""Training features: train-fit normalisation, assembly, point-in-time rows, quality counts."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.numeric import log1p_or_zero, min_max_norm
from tastemill.operators.history import WalkBatch, list_column, walk_history
from tastemill.operators.vectors import VectorSpace, cosine, elementwise_product

# The feature schema.
FEATURE_SCHEMA_VERSION = "hybrid-v1"
CONTENT_DIM = 384
CF_DIM = 64
METADATA_FIELDS = ("year", "runtime", "tmdb_popularity", "tmdb_vote_average", "tmdb_vote_count")
STAT_FIELDS = ("year", "runtime", "tmdb_popularity_log", "tmdb_vote_average", "tmdb_vote_count_log")


def feature_dim(content_dim: int = CONTENT_DIM, cf_dim: int = CF_DIM) -> int:
    return 3 * content_dim + 3 * cf_dim + 12


def slot_layout(content_dim: int = CONTENT_DIM, cf_dim: int = CF_DIM) -> list[tuple[str, int, int]]:
    """(slot, offset, width) of the ten feature slots."""
    widths = [
        ("user_content_profile", content_dim),
        ("candidate_content", content_dim),
        ("content_cosine", 1),
        ("content_product", content_dim),
        ("user_cf_profile", cf_dim),
        ("candidate_cf", cf_dim),
        ("cf_cosine", 1),
        ("cf_product", cf_dim),
        ("user_behavior", 5),
        ("candidate_metadata", 5),
    ]
    layout, at = [], 0
    for name, width in widths:
        layout.append((name, at, width))
        at += width
    return layout


def fit_metadata_stats(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of min/max bounds over the movies that occur in training.

    Min and max ignore multiplicity, so the ratings only act as a semi join.
    """
    logged = {"tmdb_popularity_log": "tmdb_popularity", "tmdb_vote_count_log": "tmdb_vote_count"}
    seen = catalog.join(train.select("movie_id").distinct(), "movie_id", "left_semi")
    aggregates: list[Column] = []
    for name in STAT_FIELDS:
        if name in logged:
            value = F.log(F.coalesce(F.col(logged[name]).cast("double"), F.lit(0.0)) + 1.0)
        else:
            value = F.col(name).cast("double")
        aggregates.append(F.coalesce(F.min(value), F.lit(0.0)).alias(f"{name}_min"))
        aggregates.append(F.coalesce(F.max(value), F.lit(0.0)).alias(f"{name}_max"))
    return seen.agg(*aggregates)


def stats_values(stats: DataFrame) -> dict[str, float]:
    """The ten bounds as plain numbers, for the manifest and as literals."""
    return stats.first().asDict()


def normalized_metadata(stats: dict[str, float]) -> list[Column]:
    """The five metadata columns scaled with train-fit bounds."""
    logged = {"tmdb_popularity", "tmdb_vote_count"}
    columns = []
    for name in METADATA_FIELDS:
        value, stat = (log1p_or_zero(F.col(name)), f"{name}_log") if name in logged else (F.col(name), name)
        bounds = F.lit(float(stats[f"{stat}_min"])), F.lit(float(stats[f"{stat}_max"]))
        columns.append(min_max_norm(value, *bounds).alias(f"{name}_norm"))
    return columns


def metadata_space(catalog: DataFrame, stats: dict[str, float], kind: str = "float") -> VectorSpace:
    """Normalised metadata as a five-wide lookup; a movie without catalog row counts as all missing."""
    columns = normalized_metadata(stats)
    names = [f"{n}_norm" for n in METADATA_FIELDS]
    movies = catalog.select("movie_id", *columns).select("movie_id", F.array(*names).alias("vector"))
    default = []
    for name in STAT_FIELDS:
        low, high = stats[f"{name}_min"], stats[f"{name}_max"]
        known = name.endswith("_log") and high > low
        default.append(min(1.0, max(0.0, -low / (high - low))) if known else 0.0)
    return VectorSpace("metadata", movies, 5, kind, tuple(default), profiled=False)


def _checked(vector: Column, dim: int, name: str) -> Column:
    wrong = F.raise_error(F.format_string(f"{name} must have {dim} values, got %d", F.size(vector)))
    return F.when(F.size(vector) == dim, vector).otherwise(wrong)


def assemble_features(
    user_content: Column,
    movie_content: Column,
    user_cf: Column,
    movie_cf: Column,
    behavior: Column,
    metadata: Column,
    content_dim: int = CONTENT_DIM,
    cf_dim: int = CF_DIM,
) -> Column:
    """One feature array in slot order, as a column expression; wrong widths raise."""
    uc, mc = _checked(user_content, content_dim, "user content"), _checked(movie_content, content_dim, "movie content")
    uf, mf = _checked(user_cf, cf_dim, "user factors"), _checked(movie_cf, cf_dim, "movie factors")
    return F.concat(
        uc,
        mc,
        F.array(cosine(uc, mc)),
        elementwise_product(uc, mc),
        uf,
        mf,
        F.array(cosine(uf, mf)),
        elementwise_product(uf, mf),
        _checked(behavior, 5, "behavior"),
        _checked(metadata, 5, "metadata"),
    )


def row_cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    scale = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    return np.where(scale > 0, np.einsum("ij,ij->i", left, right) / np.where(scale > 0, scale, 1.0), 0.0)


def assemble_matrix(
    user_content: np.ndarray,
    movie_content: np.ndarray,
    user_cf: np.ndarray,
    movie_cf: np.ndarray,
    behavior: np.ndarray,
    metadata: np.ndarray,
) -> np.ndarray:
    """The same layout for a batch of rows."""
    return np.concatenate(
        [
            user_content,
            movie_content,
            row_cosine(user_content, movie_content)[:, None],
            user_content * movie_content,
            user_cf,
            movie_cf,
            row_cosine(user_cf, movie_cf)[:, None],
            user_cf * movie_cf,
            behavior,
            metadata,
        ],
        axis=1,
    )


def feature_rows(
    ratings: DataFrame,
    content: VectorSpace,
    cf: VectorSpace,
    metadata: VectorSpace,
    *,
    kind: str = "float",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """One row per target rating with its point-in-time feature vector.

    `ratings` needs user_id, movie_id, rating, rating_timestamp, id and split, where a NULL
    split is history only. The rating itself enters the history after its own row.
    """
    value = pa.float32() if kind == "float" else pa.float64()
    keep = ["id", "user_id", "movie_id", "rating", "split"]

    def build(walked: WalkBatch) -> pa.RecordBatch:
        features = assemble_matrix(
            walked.profile("content"),
            walked.vectors["content"].astype(np.float64),
            walked.profile("cf"),
            walked.vectors["cf"].astype(np.float64),
            walked.behavior(),
            walked.vectors["metadata"].astype(np.float64),
        )
        fields = {c: walked.columns[c] for c in keep}
        fields["cold_start"] = pa.array(walked.count == 0)
        fields["missing_content"] = pa.array(walked.missing["content"])
        fields["missing_cf"] = pa.array(walked.missing["cf"])
        fields["features"] = list_column(features, value)
        return pa.RecordBatch.from_pydict(fields)

    schema = (
        "id bigint, user_id bigint, movie_id bigint, rating double, split string, "
        f"cold_start boolean, missing_content boolean, missing_cf boolean, features array<{kind}>"
    )
    narrow = ratings.select(
        F.col("user_id").cast("bigint"),
        F.col("movie_id").cast("bigint"),
        F.col("rating").cast("double"),
        "rating_timestamp",
        F.col("id").cast("bigint"),
        "split",
    )
    return walk_history(
        narrow,
        [content, cf, metadata],
        build,
        schema,
        keep,
        wanted=F.col("split").isNotNull(),
        rows_per_slice=rows_per_slice,
    )


def feature_quality(
    features: DataFrame, expected_rows: int | None = None, candidates: DataFrame | None = None, part_rows: int | None = None
) -> DataFrame:
    """One row of counts over the emitted feature rows; users are counted exactly.

    `candidates` (id) adds the candidates that have no feature row, `part_rows` the numbered parts
    of each split.
    """
    rows = F.count(F.lit(1))
    parts = []
    if part_rows is not None:
        in_split = lambda name: F.count_if(F.col("split") == name)
        parts = [F.ceil(in_split(n) / F.lit(part_rows)).cast("bigint").alias(f"{n}_parts") for n in ("train", "validation", "test")]
    measured = features.agg(
        rows.alias("rows"),
        F.count_if("cold_start").alias("cold_start_rows"),
        F.coalesce(F.count_if("cold_start") / F.nullif(rows, F.lit(0)), F.lit(0.0)).alias("cold_start_fraction"),
        F.count_if("missing_content").alias("missing_content_rows"),
        F.count_if("missing_cf").alias("missing_cf_rows"),
        F.count_distinct("user_id").alias("users"),
        *parts,
    )
    if candidates is not None:
        dropped = candidates.join(features.select("id"), "id", "left_anti").agg(rows.alias("join_dropped_candidates"))
        # Both sides have exactly one row.
        measured = measured.withColumn("one", F.lit(1)).join(dropped.withColumn("one", F.lit(1)), "one").drop("one")
    if expected_rows is None:
        return measured
    return measured.withColumn("row_count_delta", F.abs(F.col("rows") - F.lit(expected_rows)))

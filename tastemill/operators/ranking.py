"""Evaluation and final ranking: errors, ranking metrics, merging two models' lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.history import HIGH_RATING
from tastemill.operators.rank import rank_in_groups

METRICS = (
    "precision_at_5",
    "precision_at_10",
    "recall_at_5",
    "recall_at_10",
    "ndcg_at_5",
    "ndcg_at_10",
    "mrr_at_10",
)


def regression_metrics(df: DataFrame, prediction: str = "prediction", actual: str = "rating") -> DataFrame:
    """One row: rmse, mae, rows; zeros for an empty input."""
    gap = F.col(prediction) - F.col(actual)
    return df.agg(
        F.coalesce(F.sqrt(F.avg(gap * gap)), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.avg(F.abs(gap)), F.lit(0.0)).alias("mae"),
        F.count(gap).alias("rows"),
    )


def rank_by_score(df: DataFrame, score: str = "score", tie: str = "id", name: str = "rank") -> DataFrame:
    """Per-user position by score over whole lists of any length; the tie column makes it repeatable."""
    keyed = df.withColumn("__down", -F.col(score).cast("double"))
    return rank_in_groups(keyed, "user_id", ["__down", tie], name).drop("__down")


def best_by_score(df: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows per user with their position; each task keeps at most k rows per user."""
    best = Window.partitionBy("user_id").orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def _ideal_gain(relevant: Column, k: int) -> Column:
    """Best possible discounted gain with that many relevant rows (labels are 0 or 1)."""
    best, total = [], 0.0
    for place in range(1, k + 1):
        total += 1.0 / math.log2(place + 1)
        best.append(total)
    return F.element_at(F.array(*[F.lit(x) for x in best]), F.least(relevant, F.lit(k)).cast("int"))


def user_ranking_metrics(df: DataFrame, score: str = "score", tie: str = "id", threshold: float = HIGH_RATING) -> DataFrame:
    """P@5/10, R@5/10, NDCG@5/10 and MRR@10 per user.

    Only the ten best rows of a user are needed besides two counts, so the sort keeps ten
    rows per user and task. Users with fewer than two rows or nothing relevant are left out.
    """
    relevant = (F.col("rating") >= threshold).cast("double")
    totals = (
        df.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(relevant).cast("bigint").alias("relevant"))
        .where((F.col("rows") >= 2) & (F.col("relevant") > 0))
    )
    top = best_by_score(df.select("user_id", score, tie, relevant.alias("gain")), 10, score, tie)
    discounted = F.col("gain") / F.log2(F.col("rank") + 1)
    five = F.col("rank") <= 5
    hits = top.groupBy("user_id").agg(
        F.sum(F.when(five, F.col("gain")).otherwise(0.0)).alias("hits_5"),
        F.sum("gain").alias("hits_10"),
        F.sum(F.when(five, discounted).otherwise(0.0)).alias("dcg_5"),
        F.sum(discounted).alias("dcg_10"),
        F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first_hit"),
    )
    joined = totals.join(hits, "user_id")
    return joined.select(
        "user_id",
        (F.col("hits_5") / 5).alias("precision_at_5"),
        (F.col("hits_10") / 10).alias("precision_at_10"),
        (F.col("hits_5") / F.col("relevant")).alias("recall_at_5"),
        (F.col("hits_10") / F.col("relevant")).alias("recall_at_10"),
        (F.col("dcg_5") / _ideal_gain(F.col("relevant"), 5)).alias("ndcg_at_5"),
        (F.col("dcg_10") / _ideal_gain(F.col("relevant"), 10)).alias("ndcg_at_10"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr_at_10"),
    )


def ranking_metrics(df: DataFrame, score: str = "score", tie: str = "id", threshold: float = HIGH_RATING) -> DataFrame:
    """One row: mean of each metric over the evaluated users, and how many there were."""
    per_user = user_ranking_metrics(df, score, tie, threshold)
    return per_user.agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS], F.count(F.lit(1)).alias("users_evaluated")
    )


def merge_model_rankings(ranked: DataFrame, slots: DataFrame, top_k: int = 20) -> DataFrame:
    """Final list per user from two models' ranked pools.

    `ranked` has user_id, movie_id, predicted_score, model_role and rank; `slots` has user_id,
    main_slots and candidate_slots. A movie picked by both keeps the higher score, the main
    model's on equal scores.
    """
    quota = F.when(F.col("model_role") == "main", F.col("main_slots")).otherwise(F.col("candidate_slots"))
    picked = ranked.join(slots, "user_id").where(F.col("rank") <= quota)
    preference = F.struct("predicted_score", F.when(F.col("model_role") == "main", F.lit(1)).otherwise(F.lit(0)))
    others = [c for c in ranked.columns if c not in ("user_id", "movie_id", "rank")]
    kept = picked.groupBy("user_id", "movie_id").agg(
        F.max_by(F.struct(*others, F.col("rank").alias("model_rank")), preference).alias("__row")
    )
    flat = kept.select("user_id", "movie_id", "__row.*")
    # Equal scores keep the order of selection: main rows first, each model's in its own order.
    order = Window.partitionBy("user_id").orderBy(
        F.col("predicted_score").desc(), (F.col("model_role") == "main").desc(), "model_rank", "movie_id"
    )
    return (
        flat.withColumn("rank_position", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank_position") <= top_k)
        .drop("model_rank")
    )


def vector_quality(vectors: DataFrame, norms_below: float = 0.05) -> DataFrame:
    """Embedding health: NaN rows, near-zero rows, mean and population deviation of the other rows' norms."""
    length = F.sqrt(
        F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
    has_nan = F.exists("vector", lambda x: F.isnan(x))
    return vectors.select(length.alias("length"), has_nan.alias("has_nan")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("has_nan").alias("nan_rows"),
        F.count_if(F.col("length") < norms_below).alias("default_rows"),
        F.avg(F.when(~F.col("has_nan"), F.col("length"))).alias("norm_mean"),
        F.stddev_pop(F.when(~F.col("has_nan"), F.col("length"))).alias("norm_std"),
    )


def movie_coverage(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of catalog movies that occur in training."""
    seen = train.select("movie_id").distinct().withColumn("seen", F.lit(1))
    return (
        catalog.select("movie_id")
        .join(seen, "movie_id", "left")
        .agg(
            F.count("seen").alias("train_movies"),
            F.count(F.lit(1)).alias("catalog_movies"),
            (F.count("seen") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("coverage"),
        )
    )

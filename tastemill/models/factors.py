"""Collaborative filtering: factorisation, movie factors, scores, choice of the best fit."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.operators.ranking import regression_metrics
from tastemill.operators.vectors import dot, zeros
from tastemill.session import broadcast_if_small

RANK = 64
REGULARISATION = 0.05


def fit_factors(train: DataFrame, rank: int = RANK, iterations: int = 10, reg: float = REGULARISATION, seed: int = 42, **params) -> ALSModel:
    """Dot-product factorisation of (user_idx, movie_idx, rating) by squared error."""
    als = ALS(
        rank=rank, maxIter=iterations, regParam=reg, seed=seed, userCol="user_idx", itemCol="movie_idx",
        ratingCol="rating", coldStartStrategy="nan", intermediateStorageLevel="MEMORY_AND_DISK", **params,
    )
    rows = train.select(F.col("user_idx").cast("int"), F.col("movie_idx").cast("int"), F.col("rating").cast("float"))
    return als.fit(rows)


def movie_factors(model: ALSModel, movie_map: DataFrame) -> DataFrame:
    """(movie_id, cf_embedding) for every catalog movie; never-rated movies get zeros."""
    factors = model.itemFactors.select(F.col("id").alias("movie_idx"), F.col("features").alias("cf_embedding"))
    joined = movie_map.join(factors, "movie_idx", "left")
    return joined.select("movie_id", F.coalesce("cf_embedding", zeros(model.rank)).alias("cf_embedding"))


def score_factors(pairs: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """Dot product per pair; `users` has (user_idx, user_factors), `movies` (movie_idx, movie_factors)."""
    joined = pairs.join(users, "user_idx").join(broadcast_if_small(movies, 8 * RANK + 16), "movie_idx")
    return joined.withColumn("prediction", dot(F.col("user_factors"), F.col("movie_factors"))).drop(
        "user_factors", "movie_factors"
    )


def score_model(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Scores of a fitted model for mapped pairs."""
    users = model.userFactors.select(F.col("id").alias("user_idx"), F.col("features").alias("user_factors"))
    movies = model.itemFactors.select(F.col("id").alias("movie_idx"), F.col("features").alias("movie_factors"))
    return score_factors(pairs, users, movies)


def user_gradients(model: ALSModel, train: DataFrame, reg: float = REGULARISATION) -> DataFrame:
    """(user_idx, ratings, gradient, scale): how far each user's factors are from the least-squares optimum.

    A fit ends with the step that solves the users' normal equations for the final movie factors,
    so the gradient of a user's squared error, with `reg` times the number of ratings as weight of
    the squared factors, is zero there. `gradient` is its largest component, `scale` the largest
    sum of absolute terms of one component. Sums are partial before the shuffle.
    """
    users = model.userFactors.select(F.col("id").alias("user_idx"), F.col("features").alias("user_factors"))
    movies = model.itemFactors.select(F.col("id").alias("movie_idx"), F.col("features").alias("movie_factors"))
    rows = train.select(F.col("user_idx").cast("int"), F.col("movie_idx").cast("int"), F.col("rating").cast("float").cast("double"))
    joined = rows.join(users, "user_idx").join(broadcast_if_small(movies, 8 * RANK + 16), "movie_idx")
    error = dot(F.col("user_factors"), F.col("movie_factors")) - F.col("rating")
    terms = joined.withColumn("error", error).select("user_idx", "error", F.posexplode(F.arrays_zip("user_factors", "movie_factors")).alias("place", "pair"))
    own, other = F.col("pair.user_factors").cast("double"), F.col("pair.movie_factors").cast("double")
    sums = terms.groupBy("user_idx", "place").agg(
        F.count(F.lit(1)).alias("ratings"), F.sum(other * F.col("error") + reg * own).alias("gradient"), F.sum(F.abs(other * F.col("error"))).alias("scale")
    )
    return sums.groupBy("user_idx").agg(
        F.max("ratings").alias("ratings"), F.max(F.abs("gradient")).alias("gradient"), F.max("scale").alias("scale")
    )


def select_best(
    settings: Iterable[dict],
    fit: Callable[[dict], object],
    score: Callable[[object, DataFrame], DataFrame],
    validation: DataFrame,
    patience: int = 2,
) -> tuple[object, dict, list[dict]]:
    """Fit settings in turn, keep the lowest validation RMSE, stop after `patience` without progress."""
    best, best_setting, history, stale = None, {}, [], 0
    for setting in settings:
        model = fit(setting)
        metrics = regression_metrics(score(model, validation)).first().asDict()
        history.append({**setting, **metrics})
        if best is None or metrics["rmse"] < min(h["rmse"] for h in history[:-1]):
            best, best_setting, stale = model, setting, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best, best_setting, history

"""Operational counts over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.posters import is_questionable


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table"), "count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def pending_enrichment(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count_if(F.col("tmdb_id").isNotNull() & F.col("enrichment_status").isNull()).alias("pending")
    )


def enrichment_status_counts(catalog: DataFrame) -> DataFrame:
    known = catalog.where(F.col("enrichment_status").isNotNull())
    return known.groupBy(F.col("enrichment_status").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def failure_reasons(catalog: DataFrame) -> DataFrame:
    failed = catalog.where((F.col("enrichment_status") == "failed") & F.col("enrichment_last_error").isNotNull())
    return failed.groupBy(F.col("enrichment_last_error").alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def dirty_age(dirty: DataFrame, now: Column) -> DataFrame:
    """Queue length and age of its oldest row in seconds (0 for an empty queue)."""
    age = (F.unix_micros(now) - F.unix_micros(F.min("first_dirty_at"))) / 1_000_000
    return dirty.agg(
        F.count(F.lit(1)).alias("dirty_movies"), F.coalesce(age, F.lit(0.0)).alias("oldest_age_seconds")
    )


def poster_stats(catalog: DataFrame) -> DataFrame:
    has_poster = F.col("poster_path").isNotNull()
    risky = has_poster & is_questionable(F.col("adult"), F.col("certification_us"))
    return catalog.agg(
        F.count(F.lit(1)).alias("total_catalog"),
        F.count_if(has_poster).alias("total_with_poster"),
        F.count_if(risky).alias("total_questionable"),
        F.count_if(risky & F.col("poster_checked")).alias("total_already_checked"),
    )


def check_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of one poster run; poster_safe NULL means the check failed."""
    return outcomes.agg(
        F.count("poster_safe").alias("checked_count"),
        F.count_if(~F.col("poster_safe")).alias("hidden_count"),
        F.count_if("poster_safe").alias("safe_count"),
        F.count_if(F.col("poster_safe").isNull()).alias("failed_count"),
    )


def recent_runs(runs: DataFrame, job_name: str | None = None, n: int = 20) -> DataFrame:
    rows = runs if job_name is None else runs.where(F.col("job_name") == job_name)
    return rows.orderBy(F.col("started_at").desc(), "run_id").limit(n)


def last_failed_movies(catalog: DataFrame, n: int = 100) -> DataFrame:
    failed = catalog.where(F.col("enrichment_status") == "failed")
    return (
        failed.orderBy(F.col("updated_at").desc(), "movie_id")
        .limit(n)
        .select("movie_id", "title", "tmdb_id", "enrichment_last_error", F.col("updated_at").alias("failed_at"))
    )

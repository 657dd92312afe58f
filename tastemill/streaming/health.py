"""Ingest health over event-time windows; the same functions serve batch and streaming frames.

A sliding window counts a row in five minutes; all measures, including the percentile
sketches, are combined within each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE, FIVE_MINUTES, STEP = "1 minute", "5 minutes", "1 minute"
LATENESS = "10 minutes"


def watermarked(df: DataFrame, column: str = "handled_at", lateness: str = LATENESS) -> DataFrame:
    return df.withWatermark(column, lateness) if df.isStreaming else df


def event_rates(df: DataFrame) -> DataFrame:
    """Handled messages per worker and status: count and per-second rate of each minute."""
    rows = watermarked(df)
    return rows.groupBy(F.window("handled_at", MINUTE), "worker", "status").agg(
        F.count(F.lit(1)).alias("events"), (F.count(F.lit(1)) / 60.0).alias("rate")
    )


def dead_letter_counts(df: DataFrame) -> DataFrame:
    rows = watermarked(df)
    return rows.groupBy(F.window("handled_at", FIVE_MINUTES, STEP), "worker", "error_type").agg(
        F.count(F.lit(1)).alias("letters")
    )


def latency_percentiles(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Percentiles whose rank is off by at most 1 / accuracy of a window's events.

    Windows with no more events than `accuracy` are exact; the check against SQL asks for more.
    """
    rows = watermarked(df)
    percentiles = F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(accuracy))
    found = rows.groupBy(F.window("handled_at", FIVE_MINUTES, STEP), "worker").agg(
        F.count(F.lit(1)).alias("events"), percentiles.alias("p")
    )
    return found.select(
        "window", "worker", "events", F.get("p", 0).alias("p50"), F.get("p", 1).alias("p95"), F.get("p", 2).alias("p99")
    )


def error_ratio(df: DataFrame) -> DataFrame:
    """Share of failed requests; an empty window counts as one request."""
    rows = watermarked(df)
    found = rows.groupBy(F.window("handled_at", FIVE_MINUTES, STEP)).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors")
    )
    return found.withColumn("ratio", F.col("errors") / F.greatest(F.col("requests"), F.lit(1)))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Lag per topic from (topic, partition, high, position); negative gaps count as none."""
    gap = F.greatest(F.lit(0), F.col("high") - F.col("position"))
    return offsets.groupBy("topic").agg(F.sum(gap).alias("lag"))


def progress_offsets(progress: dict) -> list[tuple[str, int, int, int]]:
    """(topic, partition, high, position) rows from a streaming query's Kafka progress."""
    import json

    def as_map(offsets) -> dict:
        return json.loads(offsets) if isinstance(offsets, str) else (offsets or {})

    rows = []
    for source in progress.get("sources", []):
        end, latest = as_map(source.get("endOffset")), as_map(source.get("latestOffset"))
        for topic, partitions in latest.items():
            for partition, high in partitions.items():
                rows.append((topic, int(partition), int(high), int(end.get(topic, {}).get(partition, 0))))
    return rows

"""Domain tables derived from the shared test tables (see FIXTURES.md), whole tables only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.events import event_json, rating_event_id
from tastemill.operators.vectors import VectorSpace
from tastemill.session import ship_package, spread, use_utc

CONTENT_DIM = 64
CF_DIM = 64
NOW = "2024-02-01 00:00:00"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship_package(use_utc(spark)).read.parquet(f"{sf}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name)).alias(name)


def scrambled(event_id: Column) -> Column:
    """A bijection within blocks of 1000, so ids do not follow time."""
    return F.floor(event_id / 1000).cast("bigint") * 1000 + F.pmod(F.pmod(event_id, F.lit(1000)) * 379, F.lit(1000))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    late = (F.pmod("user_id", F.lit(10)) == 0) & (F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz"))
    removed = F.col("event_type") == "error"
    stars = F.least(F.lit(5.0), F.lit(0.5) + F.floor(F.col("value") / 10.0) * F.lit(0.5))
    return events.select(
        scrambled(F.col("event_id")).alias("id"),
        F.when(late, F.col("user_id") + 1000000).otherwise(F.col("user_id")).alias("user_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("movie_id"),
        F.when(removed, "rating_deleted").otherwise("rating_created").alias("event_type"),
        F.when(~removed, stars).alias("rating"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("rating_timestamp"),
        "event_id",
    )


def created(spark: SparkSession, sf: str) -> DataFrame:
    return ratings(spark, sf).where(F.col("rating").isNotNull())


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    key = F.col("p_partkey")
    cert = F.element_at(F.array(*[F.lit(c) for c in ("G", "PG", "PG-13", "R", "NC-17")]), (F.pmod(key, F.lit(5)) + 1).cast("int"))
    status = F.element_at(
        F.array(F.lit("enriched"), F.lit("failed"), F.lit("skipped"), F.lit(None).cast("string")),
        (F.pmod(key, F.lit(4)) + 1).cast("int"),
    )
    return part.select(
        key.alias("movie_id"),
        F.when(F.pmod(key, F.lit(17)) != 0, key + 1000).alias("tmdb_id"),
        F.concat(F.lit("tt"), F.lpad(key.cast("string"), 7, "0")).alias("imdb_id"),
        F.col("p_name").alias("title"),
        (F.lit(1970) + F.col("p_size")).cast("bigint").alias("year"),
        F.split("p_name", " ").alias("genres"),
        F.lit("en").alias("original_language"),
        F.when(F.pmod(key, F.lit(3)) != 0, F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"))).alias("overview"),
        F.when(F.pmod(key, F.lit(6)) == 0, F.lit("")).otherwise(F.col("p_type")).alias("tagline"),
        F.when(F.pmod(key, F.lit(8)) != 0, F.array(F.col("p_brand"))).alias("tmdb_keywords"),
        F.when(F.pmod(key, F.lit(7)) != 0, (F.lit(60) + 2 * F.col("p_size")).cast("bigint")).alias("runtime"),
        F.col("p_retailprice").alias("tmdb_popularity"),
        (F.pmod(key, F.lit(101)) / 10).alias("tmdb_vote_average"),
        F.pmod(key * 37, F.lit(1000)).alias("tmdb_vote_count"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.concat(F.lit("/p"), key.cast("string"), F.lit(".jpg"))).alias("poster_path"),
        (F.pmod(key, F.lit(50)) == 0).alias("adult"),
        cert.alias("certification_us"),
        (F.pmod(key, F.lit(2)) == 0).alias("poster_checked"),
        (F.pmod(key, F.lit(13)) != 0).alias("poster_safe"),
        status.alias("enrichment_status"),
        F.when(
            F.pmod(key, F.lit(4)) == 1, F.when(F.pmod(key, F.lit(3)) == 0, "not_found").otherwise("http_error")
        ).alias("enrichment_last_error"),
        F.lit("movielens").alias("source"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.pmod(key, F.lit(20)).cast("int"))).alias("updated_at"),
    )


def catalog_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Five movies are missing, for the queries about movies that are not known."""
    return catalog(spark, sf).where(~F.col("movie_id").between(95, 99))


def content_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("movie_id"), F.col("embedding").alias("vector"))


def cf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    return rows.select((F.col("vec_id") - 100).alias("movie_id"), F.col("embedding").alias("vector"))


def content_space(spark: SparkSession, sf: str) -> VectorSpace:
    """A tenth of the vectors is missing, for the queries about missing vectors."""
    return VectorSpace("content", content_vectors(spark, sf).where(F.pmod("movie_id", F.lit(10)) != 9), CONTENT_DIM)


def cf_space(spark: SparkSession, sf: str) -> VectorSpace:
    """The first vectors are missing, for the queries about missing vectors."""
    return VectorSpace("cf", cf_vectors(spark, sf).where(F.col("movie_id") >= 0), CF_DIM)


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tag events: the tag is the event type."""
    events = load(spark, sf, "events")
    return events.select(
        scrambled(F.col("event_id")).alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("movie_id"),
        F.col("event_type").alias("tag"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("tag_timestamp"),
        "event_id",
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return created(spark, sf).select(
        "id",
        "user_id",
        "movie_id",
        F.when(F.pmod("user_id", F.lit(2)) == 0, "main").otherwise("candidate").alias("model_role"),
        F.concat(F.lit("exp-"), F.pmod("movie_id", F.lit(7)).cast("string")).alias("experiment_id"),
        F.col("rating_timestamp").alias("rated_at"),
        (F.lit(1.0) + F.pmod(F.col("event_id") * 31, F.lit(9)) * F.lit(0.5)).alias("rating"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return created(spark, sf).select(
        "id", "user_id", "movie_id", "rating", (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000.0).alias("score")
    )


def dirty_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Every third movie waits for a sync."""
    rows = catalog(spark, sf).where(F.pmod("movie_id", F.lit(3)) == 0)
    hours = F.make_dt_interval(F.lit(0), F.pmod("movie_id", F.lit(48)).cast("int"))
    return rows.select(
        "movie_id",
        (F.lit("2024-01-10").cast("timestamp") + hours).alias("first_dirty_at"),
        (F.lit("2024-01-20").cast("timestamp") + hours).alias("last_dirty_at"),
        F.pmod("movie_id", F.lit(4)).alias("attempt_count"),
        F.when(F.pmod("movie_id", F.lit(2)) == 0, "timeout").alias("last_error"),
    )


def rating_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Rating events as stream messages with seeded faults by event id."""
    rows = ratings(spark, sf).withColumns(
        {
            "key_id": F.col("event_id"),
            "stream_pipeline_version": F.lit("ratings-v1"),
            "source": F.lit("movielens"),
            "occurred_at": F.col("rating_timestamp"),
            "produced_at": F.lit("2024-02-01").cast("timestamp"),
        }
    )
    stable = rating_event_id(
        F.col("user_id"), F.col("movie_id"), F.col("rating_timestamp"), F.coalesce("rating", F.lit(0.0))
    )
    rows = rows.withColumn("event_id", stable)
    order = [
        "event_id", "event_type", "stream_pipeline_version", "source", "occurred_at", "produced_at",
        "user_id", "movie_id", "rating", "rating_timestamp",
    ]
    text = event_json(rows, order)

    def every(n: int) -> Column:
        return F.pmod("key_id", F.lit(n)) == 0

    faulty = (
        F.when(every(17), F.concat(F.lit("{broken "), text))
        .when(every(19), F.lit(""))
        .when(every(23), F.regexp_replace(text, r'"rating":[0-9.]+', '"rating":"x"'))
        .when(every(29), F.regexp_replace(text, r'"event_type":"[a-z_]+"', '"event_type":"rating_updated"'))
        .when(every(37), F.regexp_replace(text, r'"user_id":(\d+)', '"user_id":"$1"'))
        .otherwise(text)
    )
    messages = rows.select(
        F.encode(faulty, "UTF-8").alias("value"),
        F.lit("ratings").alias("topic"),
        F.pmod("key_id", F.lit(4)).cast("int").alias("partition"),
        (F.floor(F.col("key_id") / 4) * 2).alias("offset"),
        "key_id",
    )
    # Messages arrive in as many pieces as the topic has partitions.
    messages = spread(messages)
    copies = messages.where(every(31)).withColumn("offset", F.col("offset") + 1)
    return messages.unionByName(copies)

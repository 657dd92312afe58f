"""Headered CSV inputs with declared schemas, and catalog seed rows made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.text import format_imdb_id, parse_genres, parse_title_year

# Columns of the input files.
RATINGS = "userId bigint, movieId bigint, rating double, timestamp bigint"
TAGS = "userId bigint, movieId bigint, tag string, timestamp bigint"
MOVIES = "movieId bigint, title string, genres string"
LINKS = "movieId bigint, imdbId string, tmdbId bigint"


def _csv(reader, schema: str):
    return reader.schema(schema).option("header", True).option("escape", '"')


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _csv(spark.read, schema).csv(path)


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RATINGS)


def read_tags_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TAGS)


def read_catalog_csv(spark: SparkSession, movies_path: str, links_path: str) -> DataFrame:
    return seed_rows(read_csv(spark, movies_path, MOVIES), read_csv(spark, links_path, LINKS))


def stream_csv(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """New files of a folder as a stream; progress lives in the query's checkpoint."""
    reader = _csv(spark.readStream, schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def seed_rows(movies: DataFrame, links: DataFrame) -> DataFrame:
    """One seed row per movie that has a link row."""
    parsed = movies.select(
        F.col("movieId").cast("bigint").alias("movie_id"),
        parse_title_year(F.col("title")).alias("p"),
        parse_genres(F.col("genres")).alias("genres"),
    )
    known = links.select(
        F.col("movieId").cast("bigint").alias("movie_id"),
        F.col("tmdbId").cast("bigint").alias("tmdb_id"),
        format_imdb_id(F.col("imdbId")).alias("imdb_id"),
    )
    return parsed.join(known, "movie_id").select("movie_id", "p.title", "p.year", "genres", "tmdb_id", "imdb_id")

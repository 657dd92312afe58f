"""Search documents of movies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.posters import show_poster

# Catalog columns copied as they are.
COPIED = (
    "title year overview tagline original_language runtime tmdb_popularity tmdb_vote_average tmdb_vote_count "
    "tmdb_id imdb_id poster_path adult certification_us poster_safe"
).split()


def movie_documents(catalog: DataFrame, tags: Column, vector: Column, version: Column) -> DataFrame:
    """One 22-field document per catalog row."""
    empty = F.array().cast("array<string>")
    shown = show_poster(
        F.col("poster_path"), F.col("poster_safe"), F.col("poster_checked"), F.col("adult"), F.col("certification_us")
    )
    return catalog.select(
        "movie_id",
        *COPIED,
        F.coalesce("genres", empty).alias("genres"),
        F.coalesce(tags, empty).alias("tags"),
        F.coalesce("tmdb_keywords", empty).alias("tmdb_keywords"),
        shown.alias("show_poster"),
        version.alias("embedding_version"),
        vector.alias("content_embedding"),
    )


def document_json(documents: DataFrame) -> DataFrame:
    """(movie_id, document) with the document as JSON text."""
    return documents.select("movie_id", F.to_json(F.struct(*documents.columns)).alias("document"))

"""Text embeddings for movies whose stored embedding is out of date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.text import embedding_is_stale, text_hash
from tastemill.operators.search import tokens

Encoder = Callable[[DataFrame], DataFrame]


def hashing_encoder(dim: int) -> Encoder:
    """Default encoder: hashed word counts of unit length (`text` -> `embedding`)."""

    def encode(df: DataFrame) -> DataFrame:
        hashed = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__counts").transform(
            df.withColumn("__words", tokens(F.col("text")))
        )
        unit = Normalizer(inputCol="__counts", outputCol="__unit").transform(hashed)
        return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__words", "__counts", "__unit")

    return encode


def stale_texts(texts: DataFrame, stored: DataFrame, dim: int) -> DataFrame:
    """Rows of (movie_id, text, …) without a usable stored embedding."""
    known = stored.select("movie_id", F.col("embedding").alias("__stored"), F.col("embedding_text_hash").alias("__hash"))
    joined = texts.join(known, "movie_id", "left")
    return joined.where(embedding_is_stale(F.col("__hash"), F.col("__stored"), F.col("text"), dim)).drop("__stored", "__hash")


def embed_stale(texts: DataFrame, stored: DataFrame, dim: int, version: str, encoder: Encoder | None = None) -> DataFrame:
    """Fresh embedding rows (movie_id, embedding_version, embedding, embedding_text_hash)."""
    encoded = (encoder or hashing_encoder(dim))(stale_texts(texts, stored, dim))
    return encoded.select(
        "movie_id", F.lit(version).alias("embedding_version"), "embedding", text_hash(F.col("text")).alias("embedding_text_hash")
    )

"""Catalog jobs: seeding, enrichment, document sync, poster checks. Tables in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.posters import SEXUAL_SCORE_LIMIT, moderation_verdict
from tastemill.functions.text import embedding_text, parse_movie_payload
from tastemill.models.encoder import Encoder, embed_stale
from tastemill.operators import merge as m
from tastemill.operators.documents import movie_documents
from tastemill.operators.monitor import check_summary
from tastemill.session import staged
from tastemill.sources.catalog_csv import read_catalog_csv
from tastemill.sources.operational import publish_documents


def seed_catalog(spark: SparkSession, movies_path: str, links_path: str, catalog: DataFrame, now: Column) -> DataFrame:
    """Next catalog version after loading the seed files."""
    return m.upsert_seed(catalog, read_catalog_csv(spark, movies_path, links_path), now)


@dataclass
class CatalogChange:
    catalog: DataFrame
    dirty: DataFrame
    summary: DataFrame


def enrich_catalog(
    catalog: DataFrame,
    dirty: DataFrame,
    payloads: DataFrame,
    now: Column,
    *,
    enrich_all: bool = False,
    after_movie_id: int = 0,
    limit: int | None = None,
) -> CatalogChange:
    """Enrich from fetched documents (tmdb_id, payload): no document = not_found, bad JSON = parse_error."""
    skipped = m.skip_without_tmdb(catalog, now)
    due = m.enrichable(skipped, enrich_all, after_movie_id)
    if limit is not None:
        due = due.orderBy("movie_id").limit(limit)
    fetched = due.select("movie_id", "tmdb_id").join(payloads, "tmdb_id", "left")
    judged = fetched.withColumn("details", parse_movie_payload(F.col("payload")))
    outcomes = judged.select(
        "movie_id",
        F.when(F.col("details").isNotNull(), "enriched").otherwise("failed").alias("status"),
        F.when(F.col("payload").isNull(), "not_found").when(F.col("details").isNull(), "parse_error").alias("error"),
        "details",
    )
    enriched = outcomes.where(F.col("status") == "enriched")
    summary = outcomes.agg(
        F.count_if(F.col("status") == "enriched").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return CatalogChange(m.apply_enrichment(skipped, outcomes, now), m.mark_dirty(dirty, enriched, now), summary)


@dataclass
class SyncResult:
    embeddings: DataFrame
    dirty: DataFrame
    outcomes: DataFrame


def sync_documents(
    catalog: DataFrame,
    dirty: DataFrame,
    tag_counts: DataFrame,
    embeddings: DataFrame,
    root: str,
    version: str,
    dim: int,
    now: Column,
    *,
    embedding_version: str,
    encoder: Encoder | None = None,
    limit: int | None = None,
    rebuild: bool = False,
) -> SyncResult:
    """Publish documents of queued movies, embedding only stale texts; one attempt per movie and run.

    The fresh embeddings are staged once, since they feed both the stored table and
    the documents and an encoder may be costly.
    """
    queue = m.mark_all_dirty(dirty, catalog, now) if rebuild else dirty
    batch = m.dirty_batch(queue, catalog, limit)
    due = batch.join(m.tags_per_movie(tag_counts), "movie_id", "left")
    text = embedding_text(
        F.col("title"), F.col("overview"), F.col("tagline"), F.col("genres"), F.col("tmdb_keywords"),
        F.coalesce("tags", F.array().cast("array<string>")),
    )
    texts = due.withColumn("text", text)
    fresh = staged(embed_stale(texts.select("movie_id", "text"), embeddings, dim, embedding_version, encoder))
    stored = m.upsert_embeddings(embeddings, fresh, now)
    vectors = stored.select("movie_id", "embedding", F.col("embedding_version").alias("__version"))
    rows = texts.join(vectors, "movie_id", "left")
    documents = movie_documents(rows, F.col("tags"), F.col("embedding"), F.col("__version"))
    outcomes = publish_documents(documents, root, version, dim, now, rebuild=rebuild)
    return SyncResult(stored, m.apply_sync_outcome(queue, outcomes, now), outcomes)


def check_posters(
    catalog: DataFrame,
    dirty: DataFrame,
    scored: DataFrame,
    now: Column,
    *,
    limit: int | None = None,
    force: bool = False,
    certification: str | None = None,
    score_limit: float = SEXUAL_SCORE_LIMIT,
) -> CatalogChange:
    """Judge questionable posters from checker results (movie_id, categories, category_scores).

    Adult movies are unsafe without a check; a missing result leaves the movie untouched.
    """
    due = m.poster_candidates(catalog, limit=limit, force=force, certification=certification).select("movie_id", "adult")
    judged = due.join(scored, "movie_id", "left").withColumn(
        "verdict", moderation_verdict(F.col("categories"), F.col("category_scores"), score_limit)
    )
    safe = F.when(F.col("adult"), F.lit(False)).when(F.col("categories").isNotNull(), F.col("verdict.poster_safe"))
    outcomes = judged.select("movie_id", safe.alias("poster_safe"), now.alias("poster_checked_at"))
    checked = outcomes.where(F.col("poster_safe").isNotNull())
    return CatalogChange(
        m.apply_poster_verdicts(catalog, checked, now), m.mark_dirty(dirty, checked, now), check_summary(outcomes)
    )

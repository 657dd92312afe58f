"""Keyed table maintenance: each rule returns the next version of a table as a DataFrame.

A rule set names the columns a change may overwrite. Rows are matched with one full outer
join on the key; commit the result as a new version (see `tastemill.sources.datasets`).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.functions.text import error_text



def nullable(kind: T.DataType) -> T.DataType:
    """The same type with NULL allowed inside arrays and maps."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def merge_tables(
    base: DataFrame,
    changes: DataFrame,
    keys: list[str],
    on_match: dict[str, Column],
    on_insert: dict[str, Column] | None,
) -> DataFrame:
    """Next version of `base`: `on_match` for keys in both, `on_insert` for new keys, rest kept.

    Rule columns refer to the sides as `base.x` and `change.x`. With `on_insert=None` new keys
    are ignored. `changes` must hold one row per key.
    """
    how = "left" if on_insert is None else "full"
    left = base.select(F.struct(*base.columns).alias("base"), *keys)
    right = changes.select(F.struct(*changes.columns).alias("change"), *keys)
    joined = left.join(right, keys, how)
    matched = F.col("base").isNotNull() & F.col("change").isNotNull()
    new = F.col("base").isNull()
    columns = []
    for field in base.schema.fields:
        name = field.name
        if name in keys:
            columns.append(F.col(name))
            continue
        kept = F.col(f"base.{name}")
        value = F.when(matched, on_match[name]).otherwise(kept) if name in on_match else kept
        if on_insert is not None:
            value = F.when(new, on_insert.get(name, F.lit(None))).otherwise(value)
        columns.append(value.cast(nullable(field.dataType)).alias(name))
    return joined.select(*columns).select(*base.columns)


def _change(*names: str) -> dict[str, Column]:
    return {n: F.col(f"change.{n}") for n in names}


def new_events(events: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """Events not stored yet; of copies inside the batch the first in `order` stays."""
    first = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    firsts = events.withColumn("__turn", first).where(F.col("__turn") == 1).select(*events.columns)
    return firsts.join(stored.select("event_id"), "event_id", "left_anti")


def upsert_seed(catalog: DataFrame, seed: DataFrame, now: Column, source: str = "movielens") -> DataFrame:
    """Seed columns overwrite, enrichment columns and created_at stay."""
    # An empty genre list is stored as NULL.
    seed = seed.withColumn("genres", F.when(F.size("genres") > 0, F.col("genres")))
    fields = _change("title", "year", "genres", "tmdb_id", "imdb_id")
    written = {**fields, "source": F.lit(source), "updated_at": now}
    defaults = {"adult": F.lit(False), "poster_checked": F.lit(False), "poster_safe": F.lit(True)}
    defaults = {n: c for n, c in defaults.items() if n in catalog.columns}
    return merge_tables(catalog, seed, ["movie_id"], written, {**written, **defaults, "created_at": now})


ENRICHED_COLUMNS = (
    "overview",
    "tagline",
    "original_language",
    "runtime",
    "tmdb_popularity",
    "tmdb_vote_average",
    "tmdb_vote_count",
    "tmdb_keywords",
    "poster_path",
    "adult",
    "certification_us",
)


def apply_enrichment(catalog: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Write enrichment outcomes (movie_id, status, error, details struct).

    enriched: detail columns written, error cleared. failed: data kept, error set.
    skipped: only the status.
    """
    status = F.col("change.status")
    enriched = (status == "enriched") & F.col("change.details").isNotNull()
    rules: dict[str, Column] = {"enrichment_status": status, "updated_at": now}
    for name in ENRICHED_COLUMNS:
        detail = F.col(f"change.details.{name}")
        if name == "tmdb_keywords":
            detail = F.when(F.size(detail) > 0, detail)
        rules[name] = F.when(enriched, detail).otherwise(F.col(f"base.{name}"))
    rules["enriched_at"] = F.when(enriched, now).otherwise(F.col("base.enriched_at"))
    rules["enrichment_last_error"] = (
        F.when(status == "failed", F.coalesce(F.nullif(F.col("change.error"), F.lit("")), F.lit("http_error")))
        .when(enriched, F.lit(None).cast("string"))
        .otherwise(F.col("base.enrichment_last_error"))
    )
    rules = {n: c for n, c in rules.items() if n in catalog.columns}
    return merge_tables(catalog, outcomes, ["movie_id"], rules, None)


def skip_without_tmdb(catalog: DataFrame, now: Column) -> DataFrame:
    idle = F.col("tmdb_id").isNull() & F.col("enrichment_status").isNull()
    return catalog.withColumns(
        {
            "updated_at": F.when(idle, now).otherwise(F.col("updated_at")),
            "enrichment_status": F.when(idle, F.lit("skipped")).otherwise(F.col("enrichment_status")),
        }
    )


def enrichable(catalog: DataFrame, enrich_all: bool = False, after_movie_id: int = 0) -> DataFrame:
    """Movies to enrich: never tried, or all with an external id after the cursor."""
    known = catalog.where(F.col("tmdb_id").isNotNull())
    if enrich_all:
        return known.where(F.col("movie_id") > after_movie_id)
    return known.where(F.col("enrichment_status").isNull())


def mark_dirty(dirty: DataFrame, movies: DataFrame, now: Column, *, reset: bool = False) -> DataFrame:
    """Queue movies for a document sync; already queued ones are touched, with `reset` also cleared."""
    touched: dict[str, Column] = {"last_dirty_at": now}
    if reset:
        touched |= {"attempt_count": F.lit(0), "last_error": F.lit(None)}
    inserted = {"first_dirty_at": now, "last_dirty_at": now, "attempt_count": F.lit(0)}
    return merge_tables(dirty, movies.select("movie_id").distinct(), ["movie_id"], touched, inserted)


def mark_all_dirty(dirty: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    return mark_dirty(dirty, catalog, now, reset=True)


def dirty_batch(dirty: DataFrame, catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued movies with their catalog row, longest waiting first."""
    joined = catalog.join(dirty.select("movie_id", "last_dirty_at", "attempt_count"), "movie_id")
    return joined if limit is None else joined.orderBy("last_dirty_at", "movie_id").limit(limit)


def apply_sync_outcome(dirty: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Synced movies leave the queue; failed ones count an attempt and keep the error."""
    done = outcomes.where("succeeded").select("movie_id")
    failed = outcomes.where(~F.col("succeeded"))
    rules = {
        "attempt_count": F.col("base.attempt_count") + 1,
        "last_error": error_text(F.col("change.error")),
        "last_dirty_at": now,
    }
    return merge_tables(dirty.join(done, "movie_id", "left_anti"), failed, ["movie_id"], rules, None)


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("movie_id", "tag").agg(F.count(F.lit(1)).alias("count"))


def sum_tag_counts(changes: DataFrame) -> DataFrame:
    """Counts of a base and of changes to it, added up per movie and tag."""
    return changes.groupBy("movie_id", "tag").agg(F.sum("count").alias("count"), F.max("updated_at").alias("updated_at"))


def add_tag_counts(counts: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Add the events of `fresh` (already without duplicates) to the stored counts."""
    added = tag_counts(fresh)
    return merge_tables(
        counts,
        added,
        ["movie_id", "tag"],
        {"count": F.col("base.count") + F.col("change.count"), "updated_at": now},
        {"count": F.col("change.count"), "updated_at": now},
    )


def upsert_embeddings(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """One embedding per movie; the newest replaces it whatever its version."""
    written = {**_change("embedding_version", "embedding", "embedding_text_hash"), "generated_at": now}
    return merge_tables(stored, fresh, ["movie_id"], written, written)


def add_embedding_version(versions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert version rows that are not known yet."""
    return versions.unionByName(fresh.join(versions.select("embedding_version"), "embedding_version", "left_anti"))


def apply_poster_verdicts(catalog: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    rules = {
        "poster_checked": F.lit(True),
        "poster_safe": F.col("change.poster_safe"),
        "poster_checked_at": F.col("change.poster_checked_at"),
        "updated_at": now,
    }
    rules = {n: c for n, c in rules.items() if n in catalog.columns}
    return merge_tables(catalog, verdicts, ["movie_id"], rules, None)


def poster_candidates(
    catalog: DataFrame, *, limit: int | None = None, force: bool = False, certification: str | None = None
) -> DataFrame:
    """Questionable movies with a poster, unchecked unless forced, by id."""
    from tastemill.functions.posters import is_questionable

    rows = catalog.where((F.coalesce("poster_path", F.lit("")) != "") & is_questionable(F.col("adult"), F.col("certification_us")))
    if not force:
        rows = rows.where(~F.col("poster_checked"))
    if certification:
        rows = rows.where(F.col("certification_us") == certification)
    return rows if not limit else rows.orderBy("movie_id").limit(limit)


def top_tags(counts: DataFrame, n: int = 10) -> DataFrame:
    """Most used tags per movie; equal counts by tag."""
    from pyspark.sql import Window

    best = Window.partitionBy("movie_id").orderBy(F.col("count").desc(), F.col("tag"))
    return counts.withColumn("tag_rank", F.row_number().over(best).cast("bigint")).where(F.col("tag_rank") <= n)


def tags_per_movie(counts: DataFrame, n: int = 10) -> DataFrame:
    """(movie_id, tags): the top tags as an ordered array of at most n."""
    ranked = top_tags(counts, n).groupBy("movie_id").agg(
        F.array_sort(F.collect_list(F.struct("tag_rank", "tag"))).alias("__t")
    )
    return ranked.select("movie_id", F.col("__t.tag").alias("tags"))

"""Table maintenance rules and operational counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.function_queries import TOP_TAGS, checker_results, payloads
from checks.registry import query
from checks.sql import CATALOG, DIRTY, RATINGS, TAGS, with_
from tastemill.functions import text as tx
from tastemill.operators import merge as m
from tastemill.operators import monitor as mo

NOW_US = "epoch_us(TIMESTAMP '2024-02-01')"


@query("tag_counts", with_(TAGS, select='SELECT movie_id, tag, count(*) AS "count" FROM tags GROUP BY ALL'))
def tag_counts(spark, sf):
    return m.tag_counts(t.tags(spark, sf))


@query("top_tags", with_(TOP_TAGS, select='SELECT movie_id, tag, "count", tag_rank FROM top'))
def top_tags(spark, sf):
    return m.top_tags(m.tag_counts(t.tags(spark, sf)), 3)


@query(
    "tag_count_merge",
    with_(TAGS, select="""SELECT movie_id, tag, count(*) AS "count",
      max(CASE WHEN event_id % 2 = 1 THEN epoch_us(TIMESTAMP '2024-02-01') ELSE epoch_us(TIMESTAMP '2024-01-01') END) AS updated_us
      FROM tags GROUP BY ALL"""),
)
def tag_count_merge(spark, sf):
    tags = t.tags(spark, sf)
    old = m.tag_counts(tags.where(F.pmod("event_id", F.lit(2)) == 0))
    old = old.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    merged = m.add_tag_counts(old, tags.where(F.pmod("event_id", F.lit(2)) == 1), t.now())
    return merged.select("movie_id", "tag", "count", F.unix_micros("updated_at").alias("updated_us"))


@query(
    "catalog_upsert",
    with_(CATALOG, select=f"""SELECT coalesce(s.movie_id, c.movie_id) AS movie_id, CASE WHEN s.movie_id IS NULL THEN c.title ELSE s.title END AS title,
      CASE WHEN s.movie_id IS NULL THEN c."year" ELSE s."year" END AS "year",
      CASE WHEN s.movie_id IS NULL THEN c.imdb_id ELSE s.imdb_id END AS imdb_id,
      c.runtime, coalesce(c.adult, false) AS adult, c.enrichment_status,
      epoch_us(coalesce(c.created_at, TIMESTAMP '2024-02-01')) AS created_us,
      CASE WHEN s.movie_id IS NULL THEN epoch_us(c.updated_at) ELSE {NOW_US} END AS updated_us
      FROM (SELECT * FROM catalog WHERE movie_id % 5 <> 0) c
      FULL JOIN (SELECT p_partkey AS movie_id, p_name || ' II' AS title, CAST(1980 + p_size AS BIGINT) AS "year", 'tt' || p_partkey AS imdb_id
        FROM part WHERE p_partkey % 3 <> 0) s USING (movie_id)"""),
)
def catalog_upsert(spark, sf):
    base = t.catalog(spark, sf).where(F.pmod("movie_id", F.lit(5)) != 0)
    seed = t.load(spark, sf, "part").where(F.pmod("p_partkey", F.lit(3)) != 0).select(
        F.col("p_partkey").alias("movie_id"),
        F.concat("p_name", F.lit(" II")).alias("title"),
        (F.lit(1980) + F.col("p_size")).cast("bigint").alias("year"),
        F.split("p_name", " ").alias("genres"),
        F.col("p_partkey").alias("tmdb_id"),
        F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("imdb_id"),
    )
    merged = m.upsert_seed(base, seed, t.now())
    return merged.select(
        "movie_id", "title", "year", "imdb_id", "runtime", "adult", "enrichment_status",
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"),
    )


OUTCOMES = """outcomes AS (SELECT movie_id, CASE movie_id % 3 WHEN 0 THEN 'enriched' WHEN 1 THEN 'failed' ELSE 'skipped' END AS outcome,
  CASE WHEN movie_id % 6 = 1 THEN 'not_found' END AS error FROM catalog WHERE movie_id % 2 = 0 OR movie_id % 3 = 1)"""


def enrichment_outcomes(spark, sf):
    key = F.col("movie_id")
    kind = F.pmod(key, F.lit(3))
    details = tx.parse_movie_payload(F.col("payload"))
    rows = payloads(spark, sf).join(t.catalog(spark, sf).select("movie_id"), "movie_id", "left_semi")
    rows = rows.where((F.pmod(key, F.lit(2)) == 0) | (kind == 1))
    return rows.select(
        "movie_id",
        F.when(kind == 0, "enriched").when(kind == 1, "failed").otherwise("skipped").alias("status"),
        F.when(F.pmod(key, F.lit(6)) == 1, "not_found").alias("error"),
        F.when(kind == 0, details).alias("details"),
    )


@query(
    "enrichment_apply",
    with_(CATALOG, OUTCOMES, select="""SELECT movie_id, coalesce(outcome, enrichment_status) AS enrichment_status,
      CASE WHEN outcome = 'failed' THEN coalesce(error, 'http_error') WHEN outcome = 'enriched' AND movie_id % 9 <> 0 THEN NULL
        ELSE enrichment_last_error END AS enrichment_last_error,
      CASE WHEN outcome = 'enriched' AND movie_id % 9 <> 0 THEN CASE WHEN movie_id % 5 <> 0 THEN CAST(p_size AS BIGINT) END ELSE runtime END AS runtime,
      CASE WHEN outcome IS NOT NULL THEN epoch_us(TIMESTAMP '2024-02-01') ELSE epoch_us(updated_at) END AS updated_us
      FROM catalog JOIN part ON p_partkey = movie_id LEFT JOIN outcomes USING (movie_id)"""),
)
def enrichment_apply(spark, sf):
    merged = m.apply_enrichment(t.catalog(spark, sf), enrichment_outcomes(spark, sf), t.now())
    return merged.select(
        "movie_id", "enrichment_status", "enrichment_last_error", "runtime", F.unix_micros("updated_at").alias("updated_us")
    )


@query(
    "skip_without_tmdb",
    with_(CATALOG, select="""SELECT movie_id, CASE WHEN tmdb_id IS NULL AND enrichment_status IS NULL THEN 'skipped' ELSE enrichment_status END AS enrichment_status,
      CASE WHEN tmdb_id IS NULL AND enrichment_status IS NULL THEN epoch_us(TIMESTAMP '2024-02-01') ELSE epoch_us(updated_at) END AS updated_us FROM catalog"""),
)
def skip_without_tmdb(spark, sf):
    rows = m.skip_without_tmdb(t.catalog(spark, sf), t.now())
    return rows.select("movie_id", "enrichment_status", F.unix_micros("updated_at").alias("updated_us"))


def queue_columns(df):
    return df.select(
        "movie_id",
        F.unix_micros("first_dirty_at").alias("first_us"),
        F.unix_micros("last_dirty_at").alias("last_us"),
        F.col("attempt_count").cast("bigint").alias("attempt_count"),
        "last_error",
    )


def queue_sql(where: str, touched: str, reset: bool) -> str:
    attempts = "CASE WHEN hit THEN 0 ELSE d.attempt_count END" if reset else "d.attempt_count"
    error = "CASE WHEN hit THEN NULL ELSE d.last_error END" if reset else "d.last_error"
    return with_(DIRTY, select=f"""SELECT movie_id, coalesce(epoch_us(first_dirty_at), {NOW_US}) AS first_us,
      CASE WHEN hit THEN {NOW_US} ELSE epoch_us(last_dirty_at) END AS last_us, coalesce({attempts}, 0) AS attempt_count, {error} AS last_error
      FROM (SELECT movie_id, {touched} AS hit FROM catalog) c LEFT JOIN dirty d USING (movie_id) WHERE d.movie_id IS NOT NULL OR hit""")


@query("dirty_merge", queue_sql("", "movie_id % 4 = 0", False))
def dirty_merge(spark, sf):
    touched = t.catalog(spark, sf).where(F.pmod("movie_id", F.lit(4)) == 0)
    return queue_columns(m.mark_dirty(t.dirty_queue(spark, sf), touched, t.now()))


@query("dirty_all", queue_sql("", "true", True))
def dirty_all(spark, sf):
    return queue_columns(m.mark_all_dirty(t.dirty_queue(spark, sf), t.catalog(spark, sf), t.now()))


@query(
    "sync_outcome",
    with_(DIRTY, select=f"""SELECT movie_id, epoch_us(first_dirty_at) AS first_us,
      CASE WHEN movie_id % 4 = 1 THEN {NOW_US} ELSE epoch_us(last_dirty_at) END AS last_us,
      attempt_count + CASE WHEN movie_id % 4 = 1 THEN 1 ELSE 0 END AS attempt_count,
      CASE WHEN movie_id % 4 = 1 THEN repeat('x', 2000) ELSE last_error END AS last_error FROM dirty WHERE movie_id % 4 <> 0"""),
)
def sync_outcome(spark, sf):
    key = F.pmod("movie_id", F.lit(4))
    tried = t.catalog(spark, sf).where(key.isin(0, 1)).select(
        "movie_id", (key == 0).alias("succeeded"), F.when(key == 1, F.repeat(F.lit("x"), 2500)).alias("error")
    )
    return queue_columns(m.apply_sync_outcome(t.dirty_queue(spark, sf), tried, t.now()))


@query(
    "dirty_batch",
    with_(DIRTY, select="""SELECT movie_id, title, attempt_count, epoch_us(last_dirty_at) AS last_us FROM dirty JOIN catalog USING (movie_id)
      ORDER BY last_dirty_at, movie_id LIMIT 50"""),
)
def dirty_batch(spark, sf):
    rows = m.dirty_batch(t.dirty_queue(spark, sf), t.catalog(spark, sf), 50)
    return rows.select("movie_id", "title", F.col("attempt_count").cast("bigint").alias("attempt_count"), F.unix_micros("last_dirty_at").alias("last_us"))


@query(
    "embedding_upsert",
    f"""SELECT coalesce(s.vec_id, f.vec_id) AS movie_id, CASE WHEN f.vec_id IS NULL THEN 'v1' ELSE 'v2' END AS embedding_version,
       CASE WHEN f.vec_id IS NULL THEN 'h1' ELSE 'h2' END AS embedding_text_hash,
       CASE WHEN f.vec_id IS NULL THEN epoch_us(TIMESTAMP '2024-01-01') ELSE {NOW_US} END AS generated_us,
       round(list_sum(coalesce(f.embedding, s.embedding)::DOUBLE[]), 6) AS total
       FROM (SELECT * FROM embeddings WHERE vec_id % 3 <> 0) s FULL JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) f USING (vec_id)""",
)
def embedding_upsert(spark, sf):
    rows = t.load(spark, sf, "embeddings").select(F.col("vec_id").alias("movie_id"), "embedding")
    key = F.col("movie_id")
    stored = rows.where(F.pmod(key, F.lit(3)) != 0).select(
        "movie_id", F.lit("v1").alias("embedding_version"), "embedding", F.lit("h1").alias("embedding_text_hash"),
        F.lit("2024-01-01").cast("timestamp").alias("generated_at"),
    )
    fresh = rows.where(F.pmod(key, F.lit(2)) == 0).select(
        "movie_id", F.lit("v2").alias("embedding_version"), "embedding", F.lit("h2").alias("embedding_text_hash")
    )
    merged = m.upsert_embeddings(stored, fresh, t.now())
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return merged.select(
        "movie_id", "embedding_version", "embedding_text_hash", F.unix_micros("generated_at").alias("generated_us"),
        F.round(total, 6).alias("total"),
    )


@query(
    "embedding_versions",
    "SELECT DISTINCT 'v' || label AS embedding_version, CASE WHEN label % 2 = 0 THEN 'old' ELSE 'new' END AS note FROM embeddings",
)
def embedding_versions(spark, sf):
    labels = t.load(spark, sf, "embeddings").select("label").distinct()
    named = labels.select("label", F.concat(F.lit("v"), F.col("label").cast("string")).alias("embedding_version"))
    known = named.where(F.pmod("label", F.lit(2)) == 0).select("embedding_version", F.lit("old").alias("note"))
    return m.add_embedding_version(known, named.select("embedding_version", F.lit("new").alias("note")))


@query(
    "poster_verdicts",
    with_(CATALOG, select=f"""SELECT movie_id, hit OR poster_checked AS poster_checked,
      CASE WHEN hit THEN NOT (movie_id % 6 = 0 OR movie_id % 14 = 0 OR (movie_id % 100) / 100.0::DOUBLE > 0.35) ELSE poster_safe END AS poster_safe,
      CASE WHEN hit THEN {NOW_US} ELSE epoch_us(updated_at) END AS updated_us
      FROM (SELECT *, poster_path IS NOT NULL AND (adult OR certification_us IN ('R', 'NC-17')) AND NOT poster_checked AS hit FROM catalog)"""),
)
def poster_verdicts(spark, sf):
    movies = t.catalog(spark, sf)
    due = m.poster_candidates(movies).select("movie_id")
    verdicts = checker_results(spark, sf).join(due, "movie_id", "left_semi").withColumn("poster_checked_at", t.now())
    merged = m.apply_poster_verdicts(movies, verdicts, t.now())
    return merged.select("movie_id", "poster_checked", "poster_safe", F.unix_micros("updated_at").alias("updated_us"))


@query(
    "poster_candidates",
    with_(CATALOG, select="""SELECT 'due' AS kind, movie_id FROM catalog WHERE poster_path IS NOT NULL AND (adult OR certification_us IN ('R', 'NC-17')) AND NOT poster_checked
      UNION ALL SELECT 'forced_r', movie_id FROM catalog WHERE poster_path IS NOT NULL AND certification_us = 'R'"""),
)
def poster_candidates(spark, sf):
    movies = t.catalog(spark, sf)
    due = m.poster_candidates(movies).select(F.lit("due").alias("kind"), "movie_id")
    forced = m.poster_candidates(movies, force=True, certification="R")
    return due.unionByName(forced.select(F.lit("forced_r").alias("kind"), "movie_id"))


# ---------------------------------------------------------------- counts


@query(
    "poster_stats",
    with_(CATALOG, select="""SELECT count(*) AS total_catalog, count(poster_path) AS total_with_poster,
      count(*) FILTER (poster_path IS NOT NULL AND (adult OR certification_us IN ('R', 'NC-17'))) AS total_questionable,
      count(*) FILTER (poster_path IS NOT NULL AND (adult OR certification_us IN ('R', 'NC-17')) AND poster_checked) AS total_already_checked FROM catalog"""),
)
def poster_stats(spark, sf):
    return mo.poster_stats(t.catalog(spark, sf))


@query(
    "poster_check_summary",
    with_(CATALOG, select="""SELECT count(safe) AS checked_count, count(*) FILTER (NOT safe) AS hidden_count, count(*) FILTER (safe) AS safe_count,
      count(*) FILTER (safe IS NULL) AS failed_count FROM (SELECT CASE WHEN movie_id % 8 <> 0 THEN
        NOT (movie_id % 6 = 0 OR movie_id % 14 = 0 OR (movie_id % 100) / 100.0::DOUBLE > 0.35) END AS safe FROM catalog)"""),
)
def poster_check_summary(spark, sf):
    safe = F.when(F.pmod("movie_id", F.lit(8)) != 0, F.col("poster_safe"))
    return mo.check_summary(checker_results(spark, sf).select(safe.alias("poster_safe")))


@query(
    "table_counts",
    with_(RATINGS, DIRTY, TAGS, select="""SELECT 'ratings_events' AS "table", count(*) AS "count" FROM ratings UNION ALL SELECT 'tag_events', count(*) FROM tags
      UNION ALL SELECT 'catalog_movies', count(*) FROM catalog UNION ALL SELECT 'catalog_dirty_movies', count(*) FROM dirty
      UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'movie_content_embeddings', count(*) FROM embeddings"""),
)
def table_counts(spark, sf):
    return mo.table_counts(
        {
            "ratings_events": t.ratings(spark, sf),
            "tag_events": t.tags(spark, sf),
            "catalog_movies": t.catalog(spark, sf),
            "catalog_dirty_movies": t.dirty_queue(spark, sf),
            "documents": t.load(spark, sf, "documents"),
            "movie_content_embeddings": t.load(spark, sf, "embeddings"),
        }
    )


@query(
    "enrichment_status",
    with_(CATALOG, select="""SELECT 'status' AS kind, enrichment_status AS name, count(*) AS "count" FROM catalog WHERE enrichment_status IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'reason', enrichment_last_error, count(*) FROM catalog WHERE enrichment_status = 'failed' AND enrichment_last_error IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'pending', 'pending', count(*) FROM catalog WHERE tmdb_id IS NOT NULL AND enrichment_status IS NULL"""),
)
def enrichment_status(spark, sf):
    movies = t.catalog(spark, sf)
    status = mo.enrichment_status_counts(movies).select(F.lit("status").alias("kind"), F.col("status").alias("name"), "count")
    reason = mo.failure_reasons(movies).select(F.lit("reason").alias("kind"), F.col("reason").alias("name"), "count")
    pending = mo.pending_enrichment(movies).select(
        F.lit("pending").alias("kind"), F.lit("pending").alias("name"), F.col("pending").alias("count")
    )
    return status.unionByName(reason).unionByName(pending)


@query(
    "dirty_age",
    with_(DIRTY, select="""SELECT count(*) AS dirty_movies, coalesce((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(first_dirty_at))) / 1000000.0, 0)::DOUBLE
      AS oldest_age_seconds FROM dirty"""),
)
def dirty_age(spark, sf):
    return mo.dirty_age(t.dirty_queue(spark, sf), t.now())


RUNS = """runs AS (SELECT 'run-' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'snapshot' ELSE 'features' END AS job_name,
  o_orderdate AS started_at, o_orderpriority AS status FROM orders)"""


def pipeline_runs(spark, sf):
    return t.load(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "snapshot").otherwise("features").alias("job_name"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_orderpriority").alias("status"),
    )


@query(
    "recent_runs",
    with_(RUNS, select="SELECT run_id, status, epoch_us(started_at) AS started_us FROM runs WHERE job_name = 'snapshot' ORDER BY started_at DESC, run_id LIMIT 20"),
)
def recent_runs(spark, sf):
    rows = mo.recent_runs(pipeline_runs(spark, sf), "snapshot", 20)
    return rows.select("run_id", "status", F.unix_micros("started_at").alias("started_us"))


@query(
    "last_failed_movies",
    with_(CATALOG, select="""SELECT movie_id, title, tmdb_id, enrichment_last_error, epoch_us(updated_at) AS failed_us FROM catalog
      WHERE enrichment_status = 'failed' ORDER BY updated_at DESC, movie_id LIMIT 100"""),
)
def last_failed_movies(spark, sf):
    rows = mo.last_failed_movies(t.catalog(spark, sf))
    return rows.select("movie_id", "title", "tmdb_id", "enrichment_last_error", F.unix_micros("failed_at").alias("failed_us"))


@query(
    "seed_rows",
    """SELECT p_partkey AS movie_id, p_name AS title, CAST(1970 + p_size AS BIGINT) AS "year", array_to_string(string_split(p_name, ' '), ';') AS genres,
       CASE WHEN p_partkey % 17 <> 0 THEN p_partkey + 1000 END AS tmdb_id, 'tt' || lpad(p_partkey::VARCHAR, 7, '0') AS imdb_id
       FROM part WHERE p_partkey % 4 <> 0""",
)
def seed_rows(spark, sf):
    from tastemill.sources.catalog_csv import seed_rows as join_seed

    parts = t.load(spark, sf, "part")
    movies = parts.where(F.pmod("p_partkey", F.lit(4)) != 0).select(
        F.col("p_partkey").alias("movieId"),
        F.concat("p_name", F.lit(" ("), (F.lit(1970) + F.col("p_size")).cast("string"), F.lit(")")).alias("title"),
        F.regexp_replace("p_name", " ", "|").alias("genres"),
    )
    links = parts.select(
        F.col("p_partkey").alias("movieId"),
        F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("imdbId"),
        F.when(F.pmod("p_partkey", F.lit(17)) != 0, F.col("p_partkey") + 1000).alias("tmdbId"),
    )
    rows = join_seed(movies, links)
    return rows.withColumns({"genres": F.array_join("genres", ";"), "year": F.col("year").cast("bigint")})

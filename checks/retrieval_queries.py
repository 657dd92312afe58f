"""Candidate buckets, merged pools and title search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.history_queries import LIKED, SHOWN_SQL, active, shown
from checks.registry import query
from checks.sql import CATALOG, CONTENT, with_
from tastemill.operators import history as h
from tastemill.operators import retrieval as ret
from tastemill.operators.search import search_titles
from tastemill.operators.vectors import VectorSpace
from tastemill.session import staged

SIZES = ret.RetrievalSizes()

PROFILES = """profiles AS (SELECT user_id, list(total / weight ORDER BY pos) AS profile FROM (
    SELECT a.user_id, p.pos, sum(a.rating) AS weight, sum(coalesce(v.vector[p.pos], 0)::DOUBLE * a.rating) AS total
    FROM active a CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) p LEFT JOIN content v USING (movie_id)
    GROUP BY a.user_id, p.pos) GROUP BY user_id)"""
POOL = """scored AS (SELECT user_id, v.movie_id,
      CASE WHEN list_dot_product(profile, profile) = 0 OR list_dot_product(w, w) = 0 THEN 0
        ELSE round(list_dot_product(profile, w) / sqrt(list_dot_product(profile, profile)) / sqrt(list_dot_product(w, w)), 9) END AS score
    FROM profiles, (SELECT movie_id, vector::DOUBLE[] AS w FROM content JOIN catalog USING (movie_id) WHERE coalesce(poster_safe, true)) v),
  near AS (SELECT * FROM (SELECT user_id, movie_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, movie_id) AS rank
    FROM scored s WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.user_id = s.user_id AND e.movie_id = s.movie_id)) WHERE rank <= 400)"""
BASE = (LIKED, CONTENT, PROFILES)
EXCLUDED = SHOWN_SQL.lstrip(", ")


def history(spark, sf):
    """Active ratings, written once since every bucket reads them."""
    return staged(active(spark, sf))


def profiles(spark, sf, rows):
    return h.weighted_profiles(rows, [VectorSpace("content", t.content_vectors(spark, sf), t.CONTENT_DIM)])


def excluded(rows):
    return h.exclude_ids(rows, shown(rows))


def safe_vectors(spark, sf):
    safe = ret.safe_movies(t.catalog(spark, sf)).select("movie_id")
    return t.content_vectors(spark, sf).join(safe, "movie_id", "left_semi")


def pool(spark, sf, rows):
    return ret.knn(profiles(spark, sf, rows), safe_vectors(spark, sf), excluded(rows), SIZES.knn_pool)


@query(
    "knn_topk",
    with_(*BASE, EXCLUDED, POOL, select="SELECT user_id, movie_id, round(score, 6) AS score, rank FROM near WHERE rank <= 250"),
)
def knn_topk(spark, sf):
    rows = history(spark, sf)
    near = ret.knn(profiles(spark, sf, rows), safe_vectors(spark, sf), excluded(rows), SIZES.knn)
    return near.withColumn("score", F.round("score", 6))


def liked(spark, sf, rows):
    return h.liked_genres(rows, t.catalog(spark, sf))


def indexed_catalog(spark, sf):
    return t.catalog(spark, sf).join(t.content_vectors(spark, sf).select("movie_id"), "movie_id", "left_semi")


GOOD = """good AS (SELECT movie_id, genres, tmdb_popularity FROM catalog
    WHERE tmdb_vote_count >= 100 AND tmdb_vote_average >= 6.0 AND coalesce(poster_safe, true)
      AND movie_id IN (SELECT movie_id FROM content)),
  by_genre AS (SELECT DISTINCT movie_id, tmdb_popularity, unnest(genres) AS genre FROM good),
  fresh AS (SELECT DISTINCT l.user_id, g.movie_id, g.tmdb_popularity FROM liked l JOIN by_genre g USING (genre)
    WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.user_id = l.user_id AND e.movie_id = g.movie_id)),
  popular AS (SELECT * FROM (SELECT user_id, movie_id, tmdb_popularity AS score,
      row_number() OVER (PARTITION BY user_id ORDER BY tmdb_popularity DESC, movie_id) AS rank FROM fresh) WHERE rank <= 50),
  drawn AS (SELECT * FROM (SELECT user_id, movie_id, row_number() OVER (PARTITION BY user_id ORDER BY (m * ((m * 16807 + 12345) % 2147483647)) % 2147483647, movie_id) AS rank
      FROM (SELECT *, ((user_id * 7 + 11) * 48271 + movie_id * 69621) % 2147483647 AS m FROM fresh)) WHERE rank <= 75)"""


@query("popular_by_genre", with_(*BASE, EXCLUDED, GOOD, select="SELECT user_id, movie_id, score, rank FROM popular"))
def popular_by_genre(spark, sf):
    rows = history(spark, sf)
    return ret.popular_by_genres(liked(spark, sf, rows), indexed_catalog(spark, sf), excluded(rows))


def seeds(rows):
    return rows.select("user_id").distinct().withColumn("seed", F.col("user_id") * 7 + 11)


@query("random_by_genre", with_(*BASE, EXCLUDED, GOOD, select="SELECT user_id, movie_id, rank FROM drawn"))
def random_by_genre(spark, sf):
    rows = history(spark, sf)
    found = ret.random_by_genres(liked(spark, sf, rows), indexed_catalog(spark, sf), excluded(rows), seeds(rows))
    return found.select("user_id", "movie_id", "rank")


TAIL = """tail AS (SELECT * FROM (SELECT user_id, movie_id, score, row_number() OVER (PARTITION BY user_id ORDER BY (m * ((m * 16807 + 12345) % 2147483647)) % 2147483647, movie_id) AS rank
    FROM (SELECT *, ((user_id * 7 + 11) * 48271 + movie_id * 69621) % 2147483647 AS m FROM near WHERE rank > 150)) WHERE rank <= 75)"""


@query("knn_tail_sample", with_(*BASE, EXCLUDED, POOL, TAIL, select="SELECT user_id, movie_id, rank FROM tail"))
def knn_tail_sample(spark, sf):
    rows = history(spark, sf)
    return ret.sample_knn_tail(pool(spark, sf, rows), seeds(rows)).select("user_id", "movie_id", "rank")


@query(
    "merged_pool",
    with_(*BASE, EXCLUDED, POOL, GOOD, TAIL, select="""
      , buckets AS (SELECT user_id, movie_id, 'knn' AS retrieval_source, 0 AS p, rank FROM near WHERE rank <= 250
        UNION ALL SELECT user_id, movie_id, 'popular', 1, rank FROM popular
        UNION ALL SELECT user_id, movie_id, 'random_genre', 2, rank FROM drawn
        UNION ALL SELECT user_id, movie_id, 'random_knn', 3, rank FROM tail WHERE user_id NOT IN (SELECT user_id FROM liked)),
      kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY p, rank) AS copy FROM buckets) WHERE copy = 1)
      SELECT * FROM (SELECT user_id, movie_id, retrieval_source, row_number() OVER (PARTITION BY user_id ORDER BY p, rank, movie_id) AS pool_rank
        FROM kept) WHERE pool_rank <= 300"""),
)
def merged_pool(spark, sf):
    rows = history(spark, sf)
    merged = ret.candidate_pool(
        profiles(spark, sf, rows), t.content_vectors(spark, sf), t.catalog(spark, sf), liked(spark, sf, rows), excluded(rows), seeds(rows)
    )
    return merged.select("user_id", "movie_id", "retrieval_source", "pool_rank")


@query(
    "safe_quality_movies",
    with_(CATALOG, select="""SELECT movie_id, title FROM catalog WHERE tmdb_vote_count >= 100 AND tmdb_vote_average >= 6.0
      AND coalesce(poster_safe, true) AND list_has_any(genres, ['red', 'blue'])"""),
)
def safe_quality_movies(spark, sf):
    genres = F.array(F.lit("red"), F.lit("blue"))
    return ret.genre_quality_filter(t.catalog(spark, sf), genres).select("movie_id", "title")


@query(
    "title_search",
    r"""WITH titles AS (SELECT doc_id AS movie_id, text AS title,
          list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents),
      asked AS (SELECT item_id AS query_id, trim(text) AS query FROM benchmark WHERE trim(text) <> ''),
      size AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words)) / count(*) FILTER (len(words) > 0)::DOUBLE AS average FROM titles),
      terms AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id,
          unnest(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM asked) GROUP BY ALL),
      tf AS (SELECT movie_id, word, count(*) AS tf FROM (SELECT movie_id, unnest(words) AS word FROM titles) GROUP BY ALL),
      df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
      body AS (SELECT query_id, movie_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf
            / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(words) / average))) AS score
          FROM terms JOIN tf USING (word) JOIN df USING (word) JOIN titles USING (movie_id), size GROUP BY query_id, movie_id),
      whole AS (SELECT query_id, movie_id, ln(1 + (n - f + 0.5) / (f + 0.5)) / 2.2 AS score
          FROM asked JOIN titles ON query = title JOIN (SELECT title, count(*) AS f FROM titles GROUP BY title) USING (title), size),
      best AS (SELECT query_id, movie_id, round(max(score), 9) AS score FROM (SELECT * FROM body UNION ALL SELECT * FROM whole) GROUP BY ALL)
      SELECT query_id, movie_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM best) WHERE rank <= 20""",
)
def title_search(spark, sf):
    titles = t.load(spark, sf, "documents").select(F.col("doc_id").alias("movie_id"), F.col("text").alias("title"))
    asked = t.load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search_titles(asked, titles, 20).withColumn("score", F.round("score", 6))


@query(
    "catalog_title_search",
    r"""WITH titles AS (SELECT p_partkey AS movie_id, p_name AS title, string_split(p_name, ' ') AS words FROM part
          WHERE p_partkey % 13 <> 0),
      asked AS (SELECT min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY p_name),
      size AS (SELECT count(*) AS n, sum(len(words)) / count(*)::DOUBLE AS average FROM titles),
      terms AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest(string_split(query, ' ')) AS word FROM asked) GROUP BY ALL),
      tf AS (SELECT movie_id, word, count(*) AS tf FROM (SELECT movie_id, unnest(words) AS word FROM titles) GROUP BY ALL),
      df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
      body AS (SELECT query_id, movie_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf
            / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(words) / average))) AS score
          FROM terms JOIN tf USING (word) JOIN df USING (word) JOIN titles USING (movie_id), size GROUP BY query_id, movie_id),
      whole AS (SELECT query_id, movie_id, ln(1 + (n - f + 0.5) / (f + 0.5)) / 2.2 AS score
          FROM asked JOIN titles ON query = title JOIN (SELECT title, count(*) AS f FROM titles GROUP BY title) USING (title), size),
      best AS (SELECT query_id, movie_id, round(max(score), 9) AS score FROM (SELECT * FROM body UNION ALL SELECT * FROM whole) GROUP BY ALL)
      SELECT query_id, movie_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, movie_id) AS rank FROM best) WHERE rank <= 20""",
)
def catalog_title_search(spark, sf):
    asked = t.load(spark, sf, "part").groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").alias("query_id"))
    return search_titles(asked, ret.safe_movies(t.catalog(spark, sf)), 20).withColumn("score", F.round("score", 6))

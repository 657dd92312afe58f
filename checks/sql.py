"""SQL fragments for the derived tables, in DuckDB's dialect."""

RATINGS = """ratings AS (
  SELECT (event_id // 1000) * 1000 + ((event_id % 1000) * 379) % 1000 AS id,
         CASE WHEN user_id % 10 = 0 AND ts >= TIMESTAMP '2024-01-28' THEN user_id + 1000000 ELSE user_id END AS user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS movie_id,
         CASE WHEN event_type = 'error' THEN 'rating_deleted' ELSE 'rating_created' END AS event_type,
         CASE WHEN event_type = 'error' THEN NULL
              ELSE least(5.0::DOUBLE, 0.5::DOUBLE + floor(value / 10.0) * 0.5::DOUBLE) END AS rating,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS rating_timestamp,
         event_id
  FROM events)"""

CREATED = RATINGS + """, created AS (SELECT * FROM ratings WHERE rating IS NOT NULL)"""

CATALOG = """catalog AS (
  SELECT p_partkey AS movie_id,
         CASE WHEN p_partkey % 17 <> 0 THEN p_partkey + 1000 END AS tmdb_id,
         'tt' || lpad(p_partkey::VARCHAR, 7, '0') AS imdb_id,
         p_name AS title,
         CAST(1970 + p_size AS BIGINT) AS "year",
         string_split(p_name, ' ') AS genres,
         'en' AS original_language,
         CASE WHEN p_partkey % 3 <> 0 THEN p_type || ' ' || p_brand END AS overview,
         CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS tagline,
         CASE WHEN p_partkey % 8 <> 0 THEN [p_brand] END AS tmdb_keywords,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(60 + 2 * p_size AS BIGINT) END AS runtime,
         p_retailprice AS tmdb_popularity,
         (p_partkey % 101) / 10.0::DOUBLE AS tmdb_vote_average,
         (p_partkey * 37) % 1000 AS tmdb_vote_count,
         CASE WHEN p_partkey % 11 <> 0 THEN '/p' || p_partkey || '.jpg' END AS poster_path,
         p_partkey % 50 = 0 AS adult,
         ['G','PG','PG-13','R','NC-17'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS certification_us,
         p_partkey % 2 = 0 AS poster_checked,
         p_partkey % 13 <> 0 AS poster_safe,
         CASE p_partkey % 4 WHEN 0 THEN 'enriched' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' END AS enrichment_status,
         CASE WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'not_found' ELSE 'http_error' END END AS enrichment_last_error,
         'movielens' AS source,
         TIMESTAMP '2024-01-01' AS created_at,
         TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 20 AS INTEGER)) AS updated_at
  FROM part)"""
# The same without five movies, for the queries about movies that are not known.
CATALOG_GAPS = CATALOG[:-1] + " WHERE p_partkey NOT BETWEEN 95 AND 99)"

CONTENT = """content AS (SELECT vec_id AS movie_id, embedding AS vector FROM embeddings)"""
CF = """cf AS (SELECT vec_id - 100 AS movie_id, embedding AS vector FROM embeddings)"""
# The same with missing vectors, for the queries about them.
CONTENT_GAPS = CONTENT[:-1] + " WHERE vec_id % 10 <> 9)"
CF_GAPS = CF[:-1] + " WHERE vec_id >= 100)"

TAGS = """tags AS (
  SELECT (event_id // 1000) * 1000 + ((event_id % 1000) * 379) % 1000 AS id, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS movie_id, event_type AS tag,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS tag_timestamp, event_id
  FROM events)"""

FEEDBACK = CREATED + """, feedback AS (
  SELECT id, user_id, movie_id, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'candidate' END AS model_role,
         'exp-' || (movie_id % 7) AS experiment_id, rating_timestamp AS rated_at,
         1.0::DOUBLE + ((event_id * 31) % 9) * 0.5::DOUBLE AS rating
  FROM created)"""

PREDICTIONS = CREATED + """, predictions AS (
  SELECT id, user_id, movie_id, rating, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS score FROM created)"""

DIRTY = CATALOG + """, dirty AS (
  SELECT movie_id, TIMESTAMP '2024-01-10' + to_hours(CAST(movie_id % 48 AS INTEGER)) AS first_dirty_at,
         TIMESTAMP '2024-01-20' + to_hours(CAST(movie_id % 48 AS INTEGER)) AS last_dirty_at,
         movie_id % 4 AS attempt_count, CASE WHEN movie_id % 2 = 0 THEN 'timeout' END AS last_error
  FROM catalog WHERE movie_id % 3 = 0)"""

LATEST = """latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY rating_timestamp DESC, id DESC) AS rn FROM ratings)
  WHERE rn = 1)"""
ACTIVE = RATINGS + ", " + LATEST + """, active AS (
  SELECT * FROM latest WHERE event_type = 'rating_created' AND rating IS NOT NULL)"""

NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (ORDER BY rating_timestamp, id) AS rn, count(*) OVER () AS total FROM ratings)"""
SPLIT = RATINGS + ", " + NUMBERED + """, split_ratings AS (
  SELECT *, CASE WHEN rn <= CAST(floor(total * 0.8) AS BIGINT) THEN 'train'
                 WHEN rn <= CAST(floor(total * 0.9) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
  FROM numbered)"""
MAPS = SPLIT + ", " + CATALOG_GAPS + """, user_map AS (
  SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx
  FROM (SELECT DISTINCT user_id FROM split_ratings WHERE split = 'train')),
movie_map AS (SELECT movie_id, row_number() OVER (ORDER BY movie_id) - 1 AS movie_idx FROM catalog)"""


def with_(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{select}"

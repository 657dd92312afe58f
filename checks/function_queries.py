"""Column functions over catalog, payload, poster and seed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from checks.sql import CATALOG, CREATED, RATINGS, TAGS, with_
from tastemill.functions import events as ev
from tastemill.functions import posters as po
from tastemill.functions import text as tx
from tastemill.functions.numeric import adler32, clamp, daily_seed, normalize_fractions, rating_in_range
from tastemill.operators import merge as m
from tastemill.session import spread


@query(
    "title_year",
    r"""SELECT key, regexp_replace(CASE WHEN hit THEN regexp_extract(cleaned, '^(.*)\s+\((\d{4})\)$', 1) ELSE cleaned END, '^\s+|\s+$', '', 'g') AS title,
        CASE WHEN hit THEN CAST(regexp_extract(cleaned, '^(.*)\s+\((\d{4})\)$', 2) AS BIGINT) END AS "year"
        FROM (SELECT key, cleaned, regexp_matches(cleaned, '^(.*)\s+\((\d{4})\)$') AS hit FROM (
          SELECT p_partkey AS key, regexp_replace('  ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1
            THEN ' (' || (1970 + p_size) || ')  ' ELSE ' (2001)  (' || p_size || ')' END, '^\s+|\s+$', '', 'g') AS cleaned FROM part))""",
)
def title_year(spark, sf):
    key = F.col("p_partkey")
    tail = (
        F.when(F.pmod(key, F.lit(3)) == 0, F.lit(""))
        .when(F.pmod(key, F.lit(3)) == 1, F.concat(F.lit(" ("), (F.lit(1970) + F.col("p_size")).cast("string"), F.lit(")  ")))
        .otherwise(F.concat(F.lit(" (2001)  ("), F.col("p_size").cast("string"), F.lit(")")))
    )
    raw = F.concat(F.lit("  "), F.col("p_name"), tail)
    parsed = t.load(spark, sf, "part").select(key.alias("key"), tx.parse_title_year(raw).alias("p"))
    return parsed.select("key", "p.title", F.col("p.year").cast("bigint").alias("year"))


@query(
    "genres",
    """SELECT key, array_to_string(list_filter(list_transform(string_split(raw, '|'), lambda g: trim(g)), lambda g: g <> ''), ';') AS genres
       FROM (SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN ''
         ELSE replace(p_name, ' ', '| ') || '|' END AS raw FROM part)""",
)
def genres(spark, sf):
    key = F.pmod("p_partkey", F.lit(5))
    raw = F.when(key == 0, F.lit("")).when(key == 1, F.lit(tx.NO_GENRES)).otherwise(
        F.concat(F.regexp_replace("p_name", " ", "| "), F.lit("|"))
    )
    return t.load(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.array_join(tx.parse_genres(raw), ";").alias("genres")
    )


@query(
    "imdb_id",
    """SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'tt' || lpad(p_partkey::VARCHAR, 7, '0')
       ELSE 'tt' || p_partkey END AS imdb_id FROM part""",
)
def imdb_id(spark, sf):
    key = F.col("p_partkey")
    raw = (
        F.when(F.pmod(key, F.lit(3)) == 0, F.lit("  "))
        .when(F.pmod(key, F.lit(3)) == 1, F.concat(F.lit(" "), F.lpad(key.cast("string"), 7, "0")))
        .otherwise(F.concat(F.lit("tt"), key.cast("string")))
    )
    return t.load(spark, sf, "part").select(key.alias("key"), tx.format_imdb_id(raw).alias("imdb_id"))


@query("epoch_seconds", with_(RATINGS, select="SELECT id, epoch_us(rating_timestamp) // 1000000 AS seconds, epoch_us(rating_timestamp) AS back_us FROM ratings"))
def epoch_seconds(spark, sf):
    rows = t.ratings(spark, sf).select("id", ev.to_epoch_seconds(F.col("rating_timestamp")).alias("seconds"))
    return rows.withColumn("back_us", F.unix_micros(ev.unix_to_utc(F.col("seconds"))))


UUID_SQL = """substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
  translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12)"""
NAMESPACE_HEX = ev.EVENT_NAMESPACE.replace("-", "")


def uuid_from(key: str) -> str:
    return f"sha1(unhex('{NAMESPACE_HEX}') || encode({key}))"


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@query(
    "event_uuid",
    with_(CREATED, select=f"""SELECT id, {UUID_SQL} AS event_id FROM (SELECT id,
      {uuid_from("'rating:' || user_id || ':' || movie_id || ':' || " + ISO.format('rating_timestamp') + " || ':' || rating")} AS d FROM created)"""),
)
def event_uuid(spark, sf):
    made = ev.rating_event_id(F.col("user_id"), F.col("movie_id"), F.col("rating_timestamp"), F.col("rating"))
    return t.created(spark, sf).select("id", made.alias("event_id"))


@query(
    "tag_event_uuid",
    with_(TAGS, select=f"""SELECT id, {UUID_SQL} AS event_id FROM (SELECT id,
      {uuid_from("'tag:' || user_id || ':' || movie_id || ':' || tag || ':' || " + ISO.format('tag_timestamp'))} AS d FROM tags)"""),
)
def tag_event_uuid(spark, sf):
    made = ev.tag_event_id(F.col("user_id"), F.col("movie_id"), F.col("tag"), F.col("tag_timestamp"))
    return t.tags(spark, sf).select("id", made.alias("event_id"))


@query(
    "csv_rating_events",
    with_(CREATED, select=f"""SELECT {UUID_SQL} AS event_id, 'rating_created' AS event_type, 'ratings-v1' AS stream_pipeline_version,
      'movielens' AS source, epoch_us(rating_timestamp) AS occurred_us, user_id, movie_id, rating FROM (SELECT *,
      {uuid_from("'rating:' || user_id || ':' || movie_id || ':' || " + ISO.format('rating_timestamp') + " || ':' || rating")} AS d FROM created)"""),
)
def csv_rating_events(spark, sf):
    rows = t.created(spark, sf).select(
        F.col("user_id").alias("userId"), F.col("movie_id").alias("movieId"), "rating",
        F.unix_seconds("rating_timestamp").alias("timestamp"),
    )
    return ev.ratings_to_events(rows, t.now()).select(
        "event_id", "event_type", "stream_pipeline_version", "source", F.unix_micros("occurred_at").alias("occurred_us"),
        "user_id", "movie_id", "rating",
    )


@query(
    "csv_tag_events",
    with_(TAGS, select=f"""SELECT {UUID_SQL} AS event_id, 'tag_created' AS event_type, 'tags-v1' AS stream_pipeline_version,
      epoch_us(tag_timestamp) AS occurred_us, user_id, movie_id, tag FROM (SELECT *,
      {uuid_from("'tag:' || user_id || ':' || movie_id || ':' || tag || ':' || " + ISO.format('tag_timestamp'))} AS d FROM tags)"""),
)
def csv_tag_events(spark, sf):
    rows = t.tags(spark, sf).select(
        F.col("user_id").alias("userId"), F.col("movie_id").alias("movieId"), "tag",
        F.unix_seconds("tag_timestamp").alias("timestamp"),
    )
    return ev.tags_to_events(rows, t.now()).select(
        "event_id", "event_type", "stream_pipeline_version", F.unix_micros("occurred_at").alias("occurred_us"),
        "user_id", "movie_id", "tag",
    )


@query("rating_range", "SELECT event_id, value / 10.0 BETWEEN 0.5 AND 5.0 AS in_range FROM events")
def rating_range(spark, sf):
    return t.load(spark, sf, "events").select("event_id", rating_in_range(F.col("value") / 10.0).alias("in_range"))


# ---------------------------------------------------------------- payloads

PAYLOAD_SQL = """SELECT p_partkey AS movie_id,
  CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS overview, 'en' AS original_language,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS runtime, p_retailprice AS tmdb_popularity,
  p_partkey % 1000 AS tmdb_vote_count, p_brand || ';' || p_type AS keywords,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 50 = 0 ELSE false END AS adult,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PG-13' WHEN 2 THEN 'R' ELSE 'G' END AS certification_us
  FROM part WHERE p_partkey % 9 <> 0
  UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 9 = 0"""


def payloads(spark, sf):
    """Movie documents as JSON text; every ninth one is broken."""
    key = F.col("p_partkey")
    name = lambda c: F.struct(c.alias("name"))
    entry = lambda c: F.struct(F.lit(c).alias("certification"))
    country = lambda code, entries: F.struct(F.lit(code).alias("iso_3166_1"), F.array(*entries).alias("release_dates"))
    foreign = country("CA", [entry("14A")])
    results = (
        F.when(F.pmod(key, F.lit(4)) == 0, F.array(foreign))
        .when(F.pmod(key, F.lit(4)) == 1, F.array(foreign, country("US", [entry(""), entry("PG-13"), entry("R")])))
        .when(F.pmod(key, F.lit(4)) == 2, F.array(country("US", [entry("  ")]), country("US", [entry(" R ")])))
        .otherwise(F.array(country("US", [entry("G")]), foreign))
    )
    doc = F.struct(
        key.alias("id"),
        F.when(F.pmod(key, F.lit(4)) != 0, F.col("p_type")).otherwise(F.lit("")).alias("overview"),
        F.lit("").alias("tagline"),
        F.lit("en").alias("original_language"),
        F.when(F.pmod(key, F.lit(5)) != 0, F.col("p_size")).alias("runtime"),
        F.col("p_retailprice").alias("popularity"),
        (F.pmod(key, F.lit(101)) / 10).alias("vote_average"),
        F.pmod(key, F.lit(1000)).alias("vote_count"),
        F.struct(F.array(name(F.col("p_brand")), name(F.lit("")), name(F.col("p_type"))).alias("keywords")).alias("keywords"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.concat(F.lit("/p"), key.cast("string"), F.lit(".jpg"))).alias("poster_path"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.pmod(key, F.lit(50)) == 0).alias("adult"),
        F.struct(results.alias("results")).alias("release_dates"),
    )
    text = F.when(F.pmod(key, F.lit(9)) == 0, F.lit('{"overview": ')).otherwise(F.to_json(doc))
    return spread(t.load(spark, sf, "part")).select(key.alias("movie_id"), text.alias("payload"))


@query("movie_payload", PAYLOAD_SQL)
def movie_payload(spark, sf):
    parsed = payloads(spark, sf).select("movie_id", tx.parse_movie_payload(F.col("payload")).alias("d"))
    return parsed.select(
        "movie_id", "d.overview", "d.original_language", F.col("d.runtime").cast("bigint").alias("runtime"),
        "d.tmdb_popularity", F.col("d.tmdb_vote_count").cast("bigint").alias("tmdb_vote_count"),
        F.array_join("d.tmdb_keywords", ";").alias("keywords"), "d.adult", "d.certification_us",
    )


@query(
    "us_certification",
    """SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'PG-13' WHEN p_partkey % 4 = 2 THEN 'R' ELSE 'G' END AS certification_us
       FROM part""",
)
def us_certification(spark, sf):
    doc = F.from_json("payload", tx.MOVIE_PAYLOAD)
    return payloads(spark, sf).select("movie_id", tx.us_certification(doc["release_dates"]).alias("certification_us"))


# ---------------------------------------------------------------- posters


@query(
    "show_poster",
    with_(CATALOG, select="""SELECT movie_id, adult OR certification_us IN ('R', 'NC-17') AS questionable,
      CASE WHEN adult THEN false WHEN poster_path IS NULL THEN false
           WHEN NOT poster_checked AND certification_us IN ('R', 'NC-17') THEN false ELSE poster_safe END AS show_poster,
      'https://image.tmdb.org/t/p/w342' || poster_path AS poster_url FROM catalog"""),
)
def show_poster(spark, sf):
    shown = po.show_poster(
        F.col("poster_path"), F.col("poster_safe"), F.col("poster_checked"), F.col("adult"), F.col("certification_us")
    )
    # Half of the paths come without their slash.
    bare = F.when(F.pmod("movie_id", F.lit(2)) == 0, F.substring("poster_path", 2, 100)).otherwise(F.col("poster_path"))
    return t.catalog(spark, sf).select(
        "movie_id",
        po.is_questionable(F.col("adult"), F.col("certification_us")).alias("questionable"),
        shown.alias("show_poster"),
        po.poster_url(bare).alias("poster_url"),
    )


def checker_results(spark, sf):
    key = F.col("movie_id")
    flags = F.create_map(
        F.lit("sexual"), F.pmod(key, F.lit(6)) == 0, F.lit("sexual/minors"), F.pmod(key, F.lit(14)) == 0, F.lit("violence"), F.lit(True)
    )
    scores = F.create_map(F.lit("sexual"), F.pmod(key, F.lit(100)) / 100.0, F.lit("violence"), F.lit(0.9))
    return t.catalog(spark, sf).select("movie_id", po.moderation_verdict(flags, scores).alias("v")).select("movie_id", "v.*")


@query(
    "moderation_verdict",
    with_(CATALOG, select="""SELECT movie_id, NOT (a OR b OR score > 0.35) AS poster_safe, score,
      CASE WHEN a OR b OR score > 0.35 THEN concat_ws('; ', CASE WHEN a THEN 'sexual=true' END, CASE WHEN b THEN 'sexual/minors=true' END,
        CASE WHEN score > 0.35 THEN format('sexual_score={:.3f}>0.350', score) END) ELSE 'no_sexual_flags' END AS reason
      FROM (SELECT movie_id, movie_id % 6 = 0 AS a, movie_id % 14 = 0 AS b, (movie_id % 100) / 100.0::DOUBLE AS score FROM catalog)"""),
)
def moderation_verdict(spark, sf):
    return checker_results(spark, sf)


# ---------------------------------------------------------------- seeds and fractions


@query(
    "daily_seeds",
    """WITH RECURSIVE texts AS (SELECT DISTINCT user_id, user_id || ':2024-02-01' || CASE WHEN user_id % 2 = 0 THEN ':again' ELSE '' END AS text FROM events),
       steps(user_id, text, i, a, b) AS (SELECT user_id, text, 0, 1::BIGINT, 0::BIGINT FROM texts
         UNION ALL SELECT user_id, text, i + 1, (a + ascii(substr(text, i + 1, 1))) % 65521,
           (b + (a + ascii(substr(text, i + 1, 1))) % 65521) % 65521 FROM steps WHERE i < length(text))
       SELECT user_id, (b * 65536 + a) % 2147483648 AS seed FROM steps WHERE i = length(text)""",
)
def daily_seeds(spark, sf):
    token = F.when(F.pmod("user_id", F.lit(2)) == 0, F.lit(" again ")).otherwise(F.lit("  "))
    users = t.load(spark, sf, "events").select("user_id").distinct()
    return users.select("user_id", daily_seed(F.col("user_id"), t.now(), token).alias("seed"))


@query(
    "fractions",
    """SELECT event_id, round(CASE WHEN m + c <= 0 THEN 1 ELSE m / (m + c) END::DOUBLE, 6) AS main,
       round(CASE WHEN m + c <= 0 THEN 0 ELSE c / (m + c) END::DOUBLE, 6) AS candidate
       FROM (SELECT event_id, greatest(0, least(0.8::DOUBLE, value / 40 - 0.2::DOUBLE)) AS m, (event_id % 4) / 4.0::DOUBLE AS c FROM events)""",
)
def fractions(spark, sf):
    main = clamp(F.col("value") / 40 - F.lit(0.2))
    pair = normalize_fractions(main, F.pmod("event_id", F.lit(4)) / F.lit(4.0))
    rows = t.load(spark, sf, "events").select("event_id", pair.alias("p"))
    return rows.select("event_id", F.round("p.main", 6).alias("main"), F.round("p.candidate", 6).alias("candidate"))


# ---------------------------------------------------------------- embedding text and documents

TOP_TAGS = TAGS + """, counted AS (SELECT movie_id, tag, count(*) AS "count" FROM tags GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY "count" DESC, tag) AS tag_rank FROM counted) WHERE tag_rank <= 3),
  movie_tags AS (SELECT movie_id, list(tag ORDER BY tag_rank) AS tags FROM top GROUP BY movie_id)"""
TEXT_SQL = """texts AS (SELECT c.*, coalesce(tags, []) AS tags,
    concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(overview), ''), nullif(trim(tagline), ''),
      CASE WHEN len(genres) > 0 THEN 'Genres: ' || array_to_string(genres, ', ') END,
      CASE WHEN len(tmdb_keywords) > 0 THEN 'Keywords: ' || array_to_string(tmdb_keywords, ', ') END,
      CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ', ') END) AS text
    FROM catalog c LEFT JOIN movie_tags USING (movie_id))"""


def texts(spark, sf):
    counted = m.tag_counts(t.tags(spark, sf))
    tags = m.tags_per_movie(counted, 3)
    rows = t.catalog(spark, sf).join(tags, "movie_id", "left")
    rows = rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    body = tx.embedding_text(
        F.col("title"), F.col("overview"), F.col("tagline"), F.col("genres"), F.col("tmdb_keywords"), F.col("tags")
    )
    return rows.withColumn("text", body)


@query(
    "embedding_text",
    with_(CATALOG, TOP_TAGS, TEXT_SQL, select="SELECT movie_id, text, sha256(text) AS text_hash FROM texts"),
)
def embedding_text(spark, sf):
    return texts(spark, sf).select("movie_id", "text", tx.text_hash(F.col("text")).alias("text_hash"))


@query(
    "stale_embeddings",
    with_(CATALOG, TOP_TAGS, TEXT_SQL, select="""SELECT movie_id, movie_id % 10 = 9 OR movie_id % 4 = 0 OR movie_id % 7 = 0
      OR movie_id NOT IN (SELECT vec_id FROM embeddings) AS stale FROM texts"""),
)
def stale_embeddings(spark, sf):
    rows = texts(spark, sf)
    hashes = rows.select(
        "movie_id", F.when(F.pmod("movie_id", F.lit(4)) == 0, F.lit("old")).otherwise(tx.text_hash(F.col("text"))).alias("stored_hash")
    )
    vector = F.when(F.pmod("movie_id", F.lit(7)) == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector"))
    stored = t.content_space(spark, sf).movies.withColumn("stored", vector).join(hashes, "movie_id")
    joined = rows.join(stored.select("movie_id", "stored", "stored_hash"), "movie_id", "left")
    stale = tx.embedding_is_stale(F.col("stored_hash"), F.col("stored"), F.col("text"), 64)
    return joined.select("movie_id", stale.alias("stale"))


@query(
    "adler32_checks",
    """WITH RECURSIVE texts AS (SELECT DISTINCT props AS text FROM events),
       steps(text, i, a, b) AS (SELECT text, 0, 1::BIGINT, 0::BIGINT FROM texts
         UNION ALL SELECT text, i + 1, (a + ascii(substr(text, i + 1, 1))) % 65521,
           (b + (a + ascii(substr(text, i + 1, 1))) % 65521) % 65521 FROM steps WHERE i < length(text))
       SELECT text, b * 65536 + a AS checksum FROM steps WHERE i = length(text)""",
)
def adler32_checks(spark, sf):
    texts = t.load(spark, sf, "events").select(F.col("props").alias("text")).distinct()
    return texts.select("text", adler32(F.col("text")).alias("checksum"))


@query("error_text", "SELECT doc_id, left(text, 2000) AS message FROM documents")
def error_text(spark, sf):
    return t.load(spark, sf, "documents").select("doc_id", tx.error_text(F.col("text")).alias("message"))


@query(
    "enrichable",
    with_(CATALOG, select="""SELECT 'new' AS mode, movie_id FROM catalog WHERE tmdb_id IS NOT NULL AND enrichment_status IS NULL
      UNION ALL SELECT 'all', movie_id FROM catalog WHERE tmdb_id IS NOT NULL AND movie_id > 50"""),
)
def enrichable(spark, sf):
    movies = t.catalog(spark, sf)
    new = m.enrichable(movies).select(F.lit("new").alias("mode"), "movie_id")
    return new.unionByName(m.enrichable(movies, True, 50).select(F.lit("all").alias("mode"), "movie_id"))


@query(
    "movie_documents",
    with_(CATALOG, TOP_TAGS, TEXT_SQL, select="""SELECT movie_id, title, array_to_string(tags, ';') AS tags,
      array_to_string(coalesce(tmdb_keywords, []), ';') AS keywords,
      CASE WHEN adult THEN false WHEN poster_path IS NULL THEN false
           WHEN NOT poster_checked AND certification_us IN ('R', 'NC-17') THEN false ELSE poster_safe END AS show_poster,
      len(vector)::BIGINT AS width, 22::BIGINT AS fields
      FROM texts JOIN (SELECT vec_id AS movie_id, embedding AS vector FROM embeddings) USING (movie_id)"""),
)
def movie_documents(spark, sf):
    from tastemill.operators.documents import movie_documents as build

    rows = texts(spark, sf).join(t.content_vectors(spark, sf), "movie_id")
    docs = build(rows, F.col("tags"), F.col("vector"), F.lit("v1"))
    return docs.select(
        "movie_id", "title", F.array_join("tags", ";").alias("tags"), F.array_join("tmdb_keywords", ";").alias("keywords"),
        "show_poster", F.size("content_embedding").cast("bigint").alias("width"), F.lit(len(docs.columns)).cast("bigint").alias("fields"),
    )

"""Active ratings, behaviour, profiles, genres, exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from checks.sql import ACTIVE, CATALOG, CATALOG_GAPS, CF_GAPS, CONTENT_GAPS, CREATED, RATINGS, SPLIT, with_
from tastemill.functions.numeric import rounded
from tastemill.operators import history as h


def active(spark, sf):
    return h.active_ratings(t.ratings(spark, sf))


@query("latest_ratings", with_(ACTIVE, select="SELECT id, user_id, movie_id, event_type, rating FROM latest"))
def latest_ratings(spark, sf):
    return h.latest_ratings(t.ratings(spark, sf)).select("id", "user_id", "movie_id", "event_type", "rating")


@query("active_ratings", with_(ACTIVE, select="SELECT id, user_id, movie_id, rating FROM active"))
def active_ratings(spark, sf):
    return active(spark, sf).select("id", "user_id", "movie_id", "rating")


@query(
    "user_rating_counts",
    with_(ACTIVE, select="SELECT user_id, count(*) AS rating_count, count(*) >= 5 AS can_recommend FROM active GROUP BY user_id"),
)
def user_rating_counts(spark, sf):
    return h.user_rating_counts(active(spark, sf))


@query(
    "ratings_with_catalog",
    with_(ACTIVE, CATALOG, select="""SELECT user_id, movie_id, rating, title, "year", poster_path, poster_safe,
      epoch_us(rating_timestamp) AS rated_us FROM active JOIN catalog USING (movie_id)"""),
)
def ratings_with_catalog(spark, sf):
    return h.ratings_with_catalog(active(spark, sf), t.catalog(spark, sf)).select(
        "user_id", "movie_id", "rating", "title", "year", "poster_path", "poster_safe",
        F.unix_micros("rating_timestamp").alias("rated_us"),
    )


@query(
    "known_and_unknown_movies",
    with_(RATINGS, CATALOG_GAPS, select="""SELECT movie_id IN (SELECT movie_id FROM catalog) AS known, count(*) AS rows,
      sum(id)::BIGINT AS id_sum FROM ratings GROUP BY 1"""),
)
def known_and_unknown_movies(spark, sf):
    rows, movies = t.ratings(spark, sf), t.catalog_with_gaps(spark, sf)
    known = h.known_movies(rows, movies).select(F.lit(True).alias("known"), "id")
    unknown = h.unknown_movies(rows, movies).select(F.lit(False).alias("known"), "id")
    return known.unionByName(unknown).groupBy("known").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("id").alias("id_sum")
    )


TARGETS = SPLIT + """, targets AS (SELECT id, split, user_id FROM split_ratings
  WHERE split <> 'train')"""


@query(
    "marked_targets",
    with_(TARGETS, select="""SELECT r.id, r.user_id, t.split FROM ratings r LEFT JOIN targets t USING (id)
      WHERE r.user_id IN (SELECT user_id FROM targets)"""),
)
def marked_targets(spark, sf):
    from checks.dataset_queries import split

    targets = split(spark, sf).where(F.col("split") != "train")
    rows = h.of_users(t.ratings(spark, sf), h.candidate_users(targets))
    return h.mark_targets(rows, targets).select("id", "user_id", "split")


@query("candidate_users", with_(TARGETS, select="SELECT DISTINCT user_id FROM targets"))
def candidate_users(spark, sf):
    from checks.dataset_queries import split

    return h.candidate_users(split(spark, sf).where(F.col("split") != "train"))


BEHAVIOR = """count(rating) AS num_user_ratings, round(coalesce(avg(rating), 0), 6) AS user_avg_rating,
  round(CASE WHEN count(rating) > 1 THEN stddev_pop(rating) ELSE 0 END, 6) AS user_rating_std,
  count(*) FILTER (rating >= 4.0) AS num_high_rated_movies, count(*) FILTER (rating <= 2.0) AS num_low_rated_movies"""


def rounded_behavior(df):
    return df.withColumns({n: F.round(n, 6) for n in ("user_avg_rating", "user_rating_std")})


@query("user_behavior", with_(ACTIVE, select=f"SELECT user_id, {BEHAVIOR} FROM active GROUP BY user_id"))
def user_behavior(spark, sf):
    return rounded_behavior(h.user_behavior(active(spark, sf)))


@query(
    "pit_behavior",
    with_(CREATED, select="""SELECT id, user_id, count(rating) OVER w AS num_user_ratings,
      round(coalesce(avg(rating) OVER w, 0), 6) AS user_avg_rating,
      round(CASE WHEN count(rating) OVER w > 1 THEN stddev_pop(rating) OVER w ELSE 0 END, 6) AS user_rating_std,
      coalesce(sum(CASE WHEN rating >= 4.0 THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS num_high_rated_movies,
      coalesce(sum(CASE WHEN rating <= 2.0 THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS num_low_rated_movies
      FROM created WINDOW w AS (PARTITION BY user_id ORDER BY rating_timestamp, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
)
def pit_behavior(spark, sf):
    walked = h.pit_behavior(t.created(spark, sf))
    return rounded_behavior(walked.select("id", "user_id", *h.BEHAVIOR_FIELDS))


@query(
    "pit_profile",
    with_(CREATED, CONTENT_GAPS, CF_GAPS, select="""
      , long AS (SELECT 'content' AS space, c.id, c.user_id, c.rating_timestamp, c.rating, p.pos,
          coalesce(v.vector[p.pos], 0)::DOUBLE * c.rating AS part
        FROM created c CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) p LEFT JOIN content v USING (movie_id)
        UNION ALL
        SELECT 'cf', c.id, c.user_id, c.rating_timestamp, c.rating, p.pos, coalesce(v.vector[p.pos], 0)::DOUBLE * c.rating
        FROM created c CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) p LEFT JOIN cf v USING (movie_id))
      SELECT space, id, prior_count, pos - 1 AS pos, round(CASE WHEN weight > 0 THEN total / weight ELSE 0 END, 6) AS value
      FROM (SELECT space, id, pos, count(*) OVER w AS prior_count, sum(part) OVER w AS total, sum(rating) OVER w AS weight
        FROM long WINDOW w AS (PARTITION BY space, user_id, pos ORDER BY rating_timestamp, id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""),
)
def pit_profile(spark, sf):
    walked = h.pit_profiles(t.created(spark, sf), [t.content_space(spark, sf), t.cf_space(spark, sf)])
    packed = F.map_from_arrays(
        F.array(F.lit("content"), F.lit("cf")), F.array("content_profile", "cf_profile")
    )
    spread = walked.select("id", "prior_count", F.explode(packed).alias("space", "profile"))
    return spread.select("space", "id", "prior_count", F.posexplode("profile").alias("pos", "value")).select(
        "space", "id", "prior_count", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("value")).alias("value")
    )


@query(
    "weighted_profile",
    with_(ACTIVE, CONTENT_GAPS, select="""
      , long AS (SELECT a.user_id, p.pos, sum(a.rating) AS weight, count(*) AS rating_count,
          sum(coalesce(v.vector[p.pos], 0)::DOUBLE * a.rating) AS total
        FROM active a CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) p LEFT JOIN content v USING (movie_id)
        GROUP BY a.user_id, p.pos)
      SELECT user_id, rating_count, weight AS total_weight, pos - 1 AS pos, round(total / weight, 6) AS value FROM long"""),
)
def weighted_profile(spark, sf):
    profiles = h.weighted_profiles(active(spark, sf), [t.content_space(spark, sf)])
    return profiles.select(
        "user_id", "rating_count", "total_weight", F.posexplode("content_profile").alias("pos", "value")
    ).select(
        "user_id", "rating_count", "total_weight", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("value")).alias("value")
    )


LIKED = ACTIVE + ", " + CATALOG + """, liked AS (
  SELECT user_id, genre, weight, genre_rank FROM (
    SELECT user_id, genre, weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, first_seen) AS genre_rank
    FROM (SELECT a.user_id, g.genre, sum(a.rating - 3.0::DOUBLE) AS weight,
            min((a.rating_timestamp, a.id, g.pos)) AS first_seen
          FROM active a JOIN catalog c USING (movie_id),
               LATERAL (SELECT unnest(c.genres) AS genre, unnest(range(len(c.genres))) AS pos) g
          WHERE a.rating > 3.0 GROUP BY a.user_id, g.genre))
  WHERE genre_rank <= 4)"""


@query("liked_genres", with_(LIKED, select="SELECT * FROM liked"))
def liked_genres(spark, sf):
    return h.liked_genres(active(spark, sf), t.catalog(spark, sf))


def new_ratings(spark, sf):
    """Fresh ratings of every user for ten movies."""
    users = active(spark, sf).select("user_id").distinct()
    movies = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.pmod(F.col("user_id") + i * 7, F.lit(100)))
    rows = users.select("user_id", F.explode(movies).alias("movie_id"))
    return rows.select(
        "user_id",
        "movie_id",
        (F.lit(0.5) + F.pmod(F.col("user_id") + F.col("movie_id"), F.lit(10)) * 0.5).alias("rating"),
        t.now().alias("rating_timestamp"),
        F.col("movie_id").alias("id"),
    )


@query(
    "overlay_ratings",
    with_(ACTIVE, select="""
      , fresh AS (SELECT user_id, (user_id + i * 7) % 100 AS movie_id FROM (SELECT DISTINCT user_id FROM active), range(10) r(i)),
      valued AS (SELECT *, 0.5::DOUBLE + ((user_id + movie_id) % 10) * 0.5::DOUBLE AS rating FROM fresh)
      SELECT user_id, movie_id, coalesce(v.rating, a.rating) AS rating,
        epoch_us(coalesce(a.rating_timestamp, TIMESTAMP '2024-02-01')) AS rated_us, coalesce(a.id, movie_id) AS id
      FROM active a FULL JOIN valued v USING (user_id, movie_id)"""),
)
def overlay_ratings(spark, sf):
    return h.overlay_ratings(active(spark, sf), new_ratings(spark, sf)).select(
        "user_id", "movie_id", "rating", F.unix_micros("rating_timestamp").alias("rated_us"), "id"
    )


SHOWN_SQL = """, shown AS (SELECT DISTINCT user_id, [(user_id * 3 + i * i) % 200 FOR i IN range(90)] AS ids FROM active),
  firsts AS (SELECT user_id, movie_id, min(pos) AS pos FROM (
      SELECT user_id, unnest(ids) AS movie_id, unnest(range(90)) AS pos FROM shown) GROUP BY ALL),
  excluded AS (SELECT user_id, movie_id FROM active UNION SELECT user_id, movie_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM firsts) WHERE rn <= 60)"""


def shown(rows):
    """A recently shown list with repeats for every user."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(89)), lambda i: F.pmod(F.col("user_id") * 3 + i * i, F.lit(200)))
    return rows.select("user_id").distinct().withColumn("shown_movie_ids", ids)


@query("exclude_ids", with_(ACTIVE, select=SHOWN_SQL + " SELECT user_id, movie_id FROM excluded"))
def exclude_ids(spark, sf):
    rows = active(spark, sf)
    return h.exclude_ids(rows, shown(rows))


@query(
    "unrated_pairs",
    with_(ACTIVE, select="""SELECT user_id, movie_id FROM (SELECT DISTINCT user_id, movie_id FROM ratings) r
      WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.user_id = r.user_id AND a.movie_id = r.movie_id)"""),
)
def unrated_pairs(spark, sf):
    pairs = t.ratings(spark, sf).select("user_id", "movie_id").distinct()
    return h.without_pairs(pairs, active(spark, sf))

"""Time split, dense indexes, joins of the training dataset, shuffle order, parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from checks.sql import CATALOG, MAPS, RATINGS, SPLIT, with_
from tastemill.operators import rank
from tastemill.operators.ranking import movie_coverage
from tastemill.session import staged


def split(spark, sf):
    return rank.temporal_split(t.ratings(spark, sf))


def maps(spark, sf):
    parts = split(spark, sf)
    users = rank.dense_index(parts.where(F.col("split") == "train"), "user_id", "user_idx")
    movies = rank.dense_index(t.catalog_with_gaps(spark, sf), "movie_id", "movie_idx")
    return parts, users, movies


def mapped(spark, sf):
    return rank.map_to_indexes(*maps(spark, sf))


def mapped_train(spark, sf):
    """Training rows, written once since numbering reads them several times."""
    return staged(mapped(spark, sf).where(F.col("split") == "train"))


@query("temporal_split", with_(SPLIT, select="SELECT id, user_id, movie_id, split FROM split_ratings"))
def temporal_split(spark, sf):
    return split(spark, sf).select("id", "user_id", "movie_id", "split")


@query(
    "split_counts",
    with_(SPLIT, select="""SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users,
      epoch_us(min(rating_timestamp)) AS first_us, epoch_us(max(rating_timestamp)) AS last_us FROM split_ratings GROUP BY split"""),
)
def split_counts(spark, sf):
    return split(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.unix_micros(F.min("rating_timestamp")).alias("first_us"),
        F.unix_micros(F.max("rating_timestamp")).alias("last_us"),
    )


@query("time_order_rank", with_(RATINGS, select="SELECT id, row_number() OVER (ORDER BY rating_timestamp, id) AS rn FROM ratings"))
def time_order_rank(spark, sf):
    return rank.global_rank(t.ratings(spark, sf), ["rating_timestamp", "id"]).select("id", "rn")


@query("dense_user_index", with_(MAPS, select="SELECT user_id, user_idx FROM user_map"))
def dense_user_index(spark, sf):
    return maps(spark, sf)[1]


@query("dense_movie_index", with_(MAPS, select="SELECT movie_id, movie_idx FROM movie_map"))
def dense_movie_index(spark, sf):
    return maps(spark, sf)[2]


MAPPED = MAPS + """, mapped AS (
  SELECT s.*, user_idx, movie_idx FROM split_ratings s JOIN user_map USING (user_id) JOIN movie_map USING (movie_id))"""


@query("cf_mapped", with_(MAPPED, select="SELECT split, id, user_idx, movie_idx, rating FROM mapped"))
def cf_mapped(spark, sf):
    return mapped(spark, sf).select("split", "id", "user_idx", "movie_idx", "rating")


@query(
    "cf_dropped",
    with_(MAPS, select="""SELECT split, count(*) AS total_rows,
      count(*) FILTER (user_idx IS NOT NULL AND movie_idx IS NOT NULL) AS mapped_rows,
      count(*) FILTER (user_idx IS NULL OR movie_idx IS NULL) AS dropped_rows,
      count(*) FILTER (user_idx IS NULL) AS unknown_user_rows,
      count(*) FILTER (movie_idx IS NULL) AS unknown_movie_rows
      FROM split_ratings LEFT JOIN user_map USING (user_id) LEFT JOIN movie_map USING (movie_id) GROUP BY split"""),
)
def cf_dropped(spark, sf):
    return rank.mapping_drops(*maps(spark, sf))


SHUFFLED = MAPPED + """, shuffled AS (
  SELECT *, md5(user_id || '-' || movie_id || '-' || epoch_us(rating_timestamp) || '-42') AS shuffle_key
  FROM mapped WHERE split = 'train')"""


@query(
    "train_shuffle_order",
    with_(SHUFFLED, select="SELECT id, row_number() OVER (ORDER BY shuffle_key, id) AS position FROM shuffled"),
)
def train_shuffle_order(spark, sf):
    train = mapped_train(spark, sf)
    return rank.shuffle_order(train, 42).select("id", "position")


@query(
    "epoch_shuffle_order",
    with_(MAPPED, select="""SELECT id, row_number() OVER (ORDER BY md5(user_id || '-' || movie_id || '-' ||
      epoch_us(rating_timestamp) || '-45'), id) AS position FROM mapped WHERE split = 'train'"""),
)
def epoch_shuffle_order(spark, sf):
    train = mapped_train(spark, sf)
    return rank.shuffle_order(train, 42, epoch=3).select("id", "position")


@query(
    "part_assignment",
    with_(SHUFFLED, select="""SELECT part_idx, count(*) AS rows, sum(id)::BIGINT AS id_sum FROM (
      SELECT id, (row_number() OVER (ORDER BY shuffle_key, id) - 1) // 500 AS part_idx FROM shuffled) GROUP BY part_idx"""),
)
def part_assignment(spark, sf):
    train = mapped_train(spark, sf).withColumn("shuffle_key", rank.shuffle_key(42))
    parts = rank.number_parts(train, ["shuffle_key", "id"], 500)
    return parts.groupBy("part_idx").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("id_sum"))


@query(
    "join_back",
    with_(MAPPED, select="""SELECT m.split, r.id, r.user_id, r.movie_id, count(*) AS copies
      FROM (SELECT split, user_idx, movie_idx, rating FROM mapped) m JOIN user_map USING (user_idx)
      JOIN movie_map USING (movie_idx)
      JOIN ratings r ON r.user_id = user_map.user_id AND r.movie_id = movie_map.movie_id AND r.rating = m.rating
      GROUP BY ALL"""),
)
def join_back(spark, sf):
    parts, users, movies = maps(spark, sf)
    rows = rank.map_to_indexes(parts, users, movies).select("split", "user_idx", "movie_idx", "rating")
    ratings = t.ratings(spark, sf).select("id", "user_id", "movie_id", "rating")
    found = rank.join_back(rows, users, movies, ratings)
    return found.groupBy("split", "id", "user_id", "movie_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "movie_coverage",
    with_(SPLIT, CATALOG, select="""SELECT count(s.movie_id) AS train_movies, count(*) AS catalog_movies,
      count(s.movie_id) / greatest(count(*), 1)::DOUBLE AS coverage
      FROM catalog LEFT JOIN (SELECT DISTINCT movie_id FROM split_ratings WHERE split = 'train') s USING (movie_id)"""),
)
def coverage(spark, sf):
    return movie_coverage(split(spark, sf).where(F.col("split") == "train"), t.catalog(spark, sf))


@query(
    "split_union",
    with_(SPLIT, select="""SELECT 'train' AS split, id FROM split_ratings WHERE split = 'train' UNION ALL
      SELECT 'validation', id FROM split_ratings WHERE split = 'validation' UNION ALL
      SELECT 'test', id FROM split_ratings WHERE split = 'test'"""),
)
def split_union(spark, sf):
    parts = split(spark, sf)
    each = [
        parts.where(F.col("split") == name).select(F.lit(name).alias("split"), "id")
        for name in ("train", "validation", "test")
    ]
    return each[0].unionByName(each[1]).unionByName(each[2])

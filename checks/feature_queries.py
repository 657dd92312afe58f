"""Normalisation, vector arithmetic, feature rows and their quality; ranking and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.dataset_queries import MAPPED, mapped, split
from checks.registry import query
from checks.sql import CATALOG, CATALOG_GAPS, CF, CF_GAPS, CONTENT, CONTENT_GAPS, PREDICTIONS, SPLIT, with_
from tastemill.functions.numeric import log1p_or_zero, min_max_norm
from tastemill.operators import features as f
from tastemill.operators import history as h
from tastemill.operators import ranking as r
from tastemill.operators.vectors import cosine, drop_bad_vectors, elementwise_product, norm, with_vector
from tastemill.session import staged

STATS = """stats AS (SELECT coalesce(min("year"), 0)::DOUBLE AS year_min, coalesce(max("year"), 0)::DOUBLE AS year_max,
  coalesce(min(runtime), 0)::DOUBLE AS runtime_min, coalesce(max(runtime), 0)::DOUBLE AS runtime_max,
  coalesce(min(ln(coalesce(tmdb_popularity, 0) + 1.0)), 0) AS tmdb_popularity_log_min,
  coalesce(max(ln(coalesce(tmdb_popularity, 0) + 1.0)), 0) AS tmdb_popularity_log_max,
  coalesce(min(tmdb_vote_average), 0) AS tmdb_vote_average_min, coalesce(max(tmdb_vote_average), 0) AS tmdb_vote_average_max,
  coalesce(min(ln(coalesce(tmdb_vote_count, 0) + 1.0)), 0) AS tmdb_vote_count_log_min,
  coalesce(max(ln(coalesce(tmdb_vote_count, 0) + 1.0)), 0) AS tmdb_vote_count_log_max
  FROM split_ratings JOIN catalog USING (movie_id) WHERE split = 'train')"""


def _norm_sql(value: str, stat: str, log: bool = False) -> str:
    if log:
        value = f"CASE WHEN {value} IS NULL OR {value} < 0 THEN 0 ELSE ln(1 + {value}) END"
    return (
        f"CASE WHEN ({value}) IS NULL OR {stat}_max <= {stat}_min THEN 0 ELSE "
        f"least(1, greatest(0, (({value})::DOUBLE - {stat}_min) / ({stat}_max - {stat}_min))) END"
    )


NORMS = {
    "year_norm": _norm_sql('"year"', "year"),
    "runtime_norm": _norm_sql("runtime", "runtime"),
    "tmdb_popularity_norm": _norm_sql("tmdb_popularity", "tmdb_popularity_log", True),
    "tmdb_vote_average_norm": _norm_sql("tmdb_vote_average", "tmdb_vote_average"),
    "tmdb_vote_count_norm": _norm_sql("tmdb_vote_count", "tmdb_vote_count_log", True),
}


def stats(spark, sf, catalog=t.catalog):
    train = split(spark, sf).where(F.col("split") == "train")
    return f.fit_metadata_stats(train, catalog(spark, sf))


STAT_NAMES = [f"{n}_{side}" for n in f.STAT_FIELDS for side in ("min", "max")]


@query(
    "metadata_stats",
    with_(SPLIT, CATALOG, STATS, select="SELECT " + ", ".join(f"round({n}, 9) AS {n}" for n in STAT_NAMES) + " FROM stats"),
)
def metadata_stats(spark, sf):
    return stats(spark, sf).select(*[F.round(n, 9).alias(n) for n in STAT_NAMES])


@query(
    "metadata_norm",
    with_(SPLIT, CATALOG, STATS, select="SELECT movie_id, "
          + ", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in NORMS.items()) + " FROM catalog, stats"),
)
def metadata_norm(spark, sf):
    bounds = f.stats_values(stats(spark, sf))
    scaled = t.catalog(spark, sf).select("movie_id", *f.normalized_metadata(bounds))
    return scaled.select("movie_id", *[F.round(n, 6).alias(n) for n in NORMS])


@query(
    "scalar_norms",
    """SELECT event_id, round(CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE least(1, greatest(0, v / 50.0)) END::DOUBLE, 6) AS scaled,
       0.0::DOUBLE AS no_range,
       round(CASE WHEN v IS NULL OR isnan(v) OR v < 0 THEN 0 ELSE ln(1 + v) END::DOUBLE, 6) AS logged
       FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE
         WHEN event_id % 11 = 0 THEN -value ELSE value END AS v FROM events)""",
)
def scalar_norms(spark, sf):
    key = F.col("event_id")
    value = (
        F.when(F.pmod(key, F.lit(5)) == 0, None)
        .when(F.pmod(key, F.lit(7)) == 0, F.lit(float("nan")))
        .when(F.pmod(key, F.lit(11)) == 0, -F.col("value"))
        .otherwise(F.col("value"))
    )
    rows = t.load(spark, sf, "events").select("event_id", value.alias("v"))
    return rows.select(
        "event_id",
        F.round(min_max_norm(F.col("v"), F.lit(0.0), F.lit(50.0)), 6).alias("scaled"),
        min_max_norm(F.col("v"), F.lit(5.0), F.lit(5.0)).alias("no_range"),
        F.round(log1p_or_zero(F.col("v")), 6).alias("logged"),
    )


@query(
    "feature_cosine",
    with_(CONTENT, CF, select="""SELECT movie_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS cosine,
      round(list_dot_product(a, b), 6) AS product_sum, round(sqrt(list_dot_product(a, a)), 6) AS length
      FROM (SELECT movie_id, content.vector::DOUBLE[] AS a, cf.vector::DOUBLE[] AS b FROM content JOIN cf USING (movie_id))"""),
)
def feature_cosine(spark, sf):
    left = t.content_vectors(spark, sf).select("movie_id", F.col("vector").cast("array<double>").alias("a"))
    right = t.cf_vectors(spark, sf).select("movie_id", F.col("vector").cast("array<double>").alias("b"))
    product = elementwise_product(F.col("a"), F.col("b"))
    return left.join(right, "movie_id").select(
        "movie_id",
        F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine"),
        F.round(F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x), 6).alias("product_sum"),
        F.round(norm(F.col("a")), 6).alias("length"),
    )


@query(
    "good_vectors",
    "SELECT vec_id AS movie_id, label::BIGINT AS label FROM embeddings WHERE vec_id % 3 <> 0",
)
def good_vectors(spark, sf):
    cut = F.when(F.pmod("vec_id", F.lit(3)) == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    rows = t.load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("movie_id"), F.col("label").cast("bigint").alias("label"), cut.alias("vector")
    )
    return drop_bad_vectors(rows, 64).select("movie_id", "label")


@query(
    "vector_lookup",
    with_(CATALOG_GAPS, CONTENT_GAPS, select="""SELECT movie_id, vector IS NULL AS missing_content,
      round(CASE WHEN vector IS NULL THEN 0 ELSE list_sum(vector::DOUBLE[]) END, 6) AS total
      FROM catalog LEFT JOIN content USING (movie_id)"""),
)
def vector_lookup(spark, sf):
    found = with_vector(t.catalog_with_gaps(spark, sf).select("movie_id"), t.content_space(spark, sf))
    total = F.aggregate("content_vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return found.select("movie_id", "missing_content", F.round(total, 6).alias("total"))


# Slot sums of the point-in-time feature vector, computed long in SQL.
FEATURES = MAPPED + ", " + STATS + ", " + CONTENT_GAPS + ", " + CF_GAPS + """,
  hist AS (SELECT r.*, m.split IS NOT NULL AS is_target, m.split AS target_split FROM ratings r
    LEFT JOIN mapped m USING (id) WHERE r.rating IS NOT NULL AND r.user_id IN (SELECT user_id FROM mapped)),
  dims AS (SELECT unnest(range(1, 65)) AS pos),
  long AS (SELECT 'content' AS space, h.id, h.user_id, h.rating_timestamp, h.rating, h.is_target, pos,
      coalesce(v.vector[pos], 0)::DOUBLE AS item, v.vector IS NULL AS missing
    FROM hist h CROSS JOIN dims LEFT JOIN content v USING (movie_id)
    UNION ALL
    SELECT 'cf', h.id, h.user_id, h.rating_timestamp, h.rating, h.is_target, pos, coalesce(v.vector[pos], 0)::DOUBLE, v.vector IS NULL
    FROM hist h CROSS JOIN dims LEFT JOIN cf v USING (movie_id)),
  walked AS (SELECT space, id, is_target, pos, item, missing, count(*) OVER w AS n,
      CASE WHEN sum(rating) OVER w > 0 THEN sum(item * rating) OVER w / sum(rating) OVER w ELSE 0 END AS profile
    FROM long WINDOW w AS (PARTITION BY space, user_id, pos ORDER BY rating_timestamp, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  slots AS (SELECT space, id, any_value(n) AS n, any_value(missing) AS missing, sum(profile) AS profile_sum, sum(item) AS item_sum,
      sum(profile * item) AS product_sum,
      CASE WHEN sum(profile * profile) * sum(item * item) > 0
           THEN sum(profile * item) / sqrt(sum(profile * profile) * sum(item * item)) ELSE 0 END AS cosine
    FROM walked WHERE is_target GROUP BY space, id)"""


def pit_features(spark, sf, kind="double"):
    """Feature rows of all mapped ratings; removals are no ratings and carry no target."""
    rows = staged(mapped(spark, sf))
    history = h.of_users(t.created(spark, sf), h.candidate_users(rows))
    marked = staged(h.mark_targets(history, rows))
    bounds = f.stats_values(stats(spark, sf, t.catalog_with_gaps))
    metadata = f.metadata_space(t.catalog_with_gaps(spark, sf), bounds, kind)
    return f.feature_rows(marked, t.content_space(spark, sf), t.cf_space(spark, sf), metadata, kind=kind)


@query(
    "feature_vector_slots",
    with_(FEATURES, select="""SELECT a.id, h.target_split AS split, round(a.profile_sum, 6) AS user_content_profile, round(a.item_sum, 6) AS candidate_content,
      round(a.cosine, 6) AS content_cosine, round(a.product_sum, 6) AS content_product, round(b.profile_sum, 6) AS user_cf_profile,
      round(b.item_sum, 6) AS candidate_cf, round(b.cosine, 6) AS cf_cosine, round(b.product_sum, 6) AS cf_product,
      a.n = 0 AS cold_start, a.missing AS missing_content, b.missing AS missing_cf
      FROM slots a JOIN slots b ON a.id = b.id AND a.space = 'content' AND b.space = 'cf' JOIN hist h ON h.id = a.id"""),
)
def feature_vector_slots(spark, sf):
    rows = pit_features(spark, sf)
    sums = [
        F.round(F.aggregate(F.slice("features", at + 1, width), F.lit(0.0), lambda acc, x: acc + x), 6).alias(name)
        for name, at, width in f.slot_layout(t.CONTENT_DIM, t.CF_DIM)
        if name not in ("user_behavior", "candidate_metadata")
    ]
    return rows.select("id", "split", *sums, "cold_start", "missing_content", "missing_cf")


@query(
    "feature_vector_tail",
    with_(FEATURES, select="SELECT id, n::DOUBLE AS num_user_ratings, round(avg_rating, 6) AS user_avg_rating, round(std, 6) AS user_rating_std, "
          + "high::DOUBLE AS num_high_rated_movies, low::DOUBLE AS num_low_rated_movies, "
          + ", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in NORMS.items())
          + """ FROM (SELECT id, movie_id, is_target, count(*) OVER w AS n, coalesce(avg(rating) OVER w, 0) AS avg_rating,
            CASE WHEN count(*) OVER w > 1 THEN stddev_pop(rating) OVER w ELSE 0 END AS std,
            coalesce(sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) OVER w, 0) AS high,
            coalesce(sum(CASE WHEN rating <= 2 THEN 1 ELSE 0 END) OVER w, 0) AS low
            FROM hist WINDOW w AS (PARTITION BY user_id ORDER BY rating_timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
          LEFT JOIN catalog USING (movie_id), stats WHERE is_target"""),
)
def feature_vector_tail(spark, sf):
    rows = pit_features(spark, sf)
    at = f.feature_dim(t.CONTENT_DIM, t.CF_DIM) - 10
    names = [*h.BEHAVIOR_FIELDS, *NORMS]
    return rows.select("id", *[F.round(F.get("features", at + i), 6).alias(n) for i, n in enumerate(names)])


@query(
    "feature_quality",
    with_(FEATURES, select="""SELECT count(*) AS rows, count(*) FILTER (a.n = 0) AS cold_start_rows,
      round(count(*) FILTER (a.n = 0) / count(*)::DOUBLE, 9) AS cold_start_fraction,
      count(*) FILTER (a.missing) AS missing_content_rows, count(*) FILTER (b.missing) AS missing_cf_rows,
      count(DISTINCT h.user_id) AS users,
      ceil(count(*) FILTER (h.target_split = 'train') / 1000.0)::BIGINT AS train_parts,
      ceil(count(*) FILTER (h.target_split = 'validation') / 1000.0)::BIGINT AS validation_parts,
      ceil(count(*) FILTER (h.target_split = 'test') / 1000.0)::BIGINT AS test_parts,
      (SELECT count(*) FROM mapped WHERE id NOT IN (SELECT id FROM slots)) AS join_dropped_candidates
      FROM slots a JOIN slots b ON a.id = b.id AND a.space = 'content' AND b.space = 'cf' JOIN hist h ON h.id = a.id"""),
)
def feature_quality(spark, sf):
    rows = staged(pit_features(spark, sf).select("id", "user_id", "split", "cold_start", "missing_content", "missing_cf"))
    return f.feature_quality(rows, candidates=mapped(spark, sf), part_rows=1000).withColumn(
        "cold_start_fraction", F.round("cold_start_fraction", 9)
    )


@query(
    "assembled_features",
    with_(CONTENT, CF, select="""SELECT movie_id, 396::BIGINT AS width, round(list_sum(a) + list_sum(b) + list_sum(b) + list_sum(a)
      + 2 * list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) + 2 * list_dot_product(a, b) + 15 + 1.5, 6) AS total
      FROM (SELECT movie_id, content.vector::DOUBLE[] AS a, cf.vector::DOUBLE[] AS b FROM content JOIN cf USING (movie_id))"""),
)
def assembled_features(spark, sf):
    left = t.content_vectors(spark, sf).select("movie_id", F.col("vector").cast("array<double>").alias("a"))
    right = t.cf_vectors(spark, sf).select("movie_id", F.col("vector").cast("array<double>").alias("b"))
    behavior = F.array(*[F.lit(float(i)) for i in range(1, 6)])
    metadata = F.array(*[F.lit(0.3)] * 5)
    a, b = F.col("a"), F.col("b")
    features = f.assemble_features(a, b, b, a, behavior, metadata, 64, 64)
    packed = left.join(right, "movie_id").select("movie_id", features.alias("features"))
    return packed.select(
        "movie_id",
        F.size("features").cast("bigint").alias("width"),
        F.round(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
    )


# ---------------------------------------------------------------- metrics

METRIC_SQL = """ranked AS (SELECT *, CASE WHEN rating >= 4.0 THEN 1 ELSE 0 END AS gain,
    row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM predictions),
  ideal AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, id) AS best FROM ranked),
  per_user AS (SELECT user_id, sum(gain) FILTER (rank <= 5) / 5.0 AS precision_at_5, sum(gain) FILTER (rank <= 10) / 10.0 AS precision_at_10,
    sum(gain) FILTER (rank <= 5) / sum(gain) AS recall_at_5, sum(gain) FILTER (rank <= 10) / sum(gain) AS recall_at_10,
    sum(gain / log2(rank + 1)) FILTER (rank <= 5) / sum(gain / log2(best + 1)) FILTER (best <= 5) AS ndcg_at_5,
    sum(gain / log2(rank + 1)) FILTER (rank <= 10) / sum(gain / log2(best + 1)) FILTER (best <= 10) AS ndcg_at_10,
    coalesce(1.0 / min(rank) FILTER (gain = 1 AND rank <= 10), 0) AS mrr_at_10
    FROM ideal GROUP BY user_id HAVING count(*) >= 2 AND sum(gain) > 0)"""


@query(
    "user_rank_metrics",
    with_(PREDICTIONS, METRIC_SQL, select="SELECT user_id, " + ", ".join(f"round({m}::DOUBLE, 6) AS {m}" for m in r.METRICS) + " FROM per_user"),
)
def user_rank_metrics(spark, sf):
    per_user = r.user_ranking_metrics(t.predictions(spark, sf))
    return per_user.select("user_id", *[F.round(m, 6).alias(m) for m in r.METRICS])


@query(
    "rank_metrics",
    with_(PREDICTIONS, METRIC_SQL, select="SELECT " + ", ".join(f"round(avg({m})::DOUBLE, 6) AS {m}" for m in r.METRICS)
          + ", count(*) AS users_evaluated FROM per_user"),
)
def rank_metrics(spark, sf):
    return r.ranking_metrics(t.predictions(spark, sf)).select(
        *[F.round(m, 6).alias(m) for m in r.METRICS], "users_evaluated"
    )


@query(
    "score_ranks",
    with_(PREDICTIONS, select="SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM predictions"),
)
def score_ranks(spark, sf):
    return r.rank_by_score(t.predictions(spark, sf)).select("id", "user_id", "rank")


@query(
    "regression_metrics",
    with_(PREDICTIONS, select="""SELECT round(sqrt(avg(power(score * 5 - rating, 2))), 6) AS rmse,
      round(avg(abs(score * 5 - rating)), 6) AS mae, count(*) AS rows FROM predictions"""),
)
def regression_metrics(spark, sf):
    rows = t.predictions(spark, sf).withColumn("prediction", F.col("score") * 5)
    return r.regression_metrics(rows).select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "rows")


def mixed_vectors(spark, sf):
    """Some vectors shrunk to almost nothing, some with undefined values."""
    key = F.col("vec_id")
    shrunk = F.transform(F.col("embedding").cast("array<double>"), lambda x: x / 100)
    nan = F.array_repeat(F.lit(float("nan")), 64)
    vector = (
        F.when(F.pmod(key, F.lit(50)) == 0, nan)
        .when(F.pmod(key, F.lit(20)) == 3, shrunk)
        .otherwise(F.col("embedding").cast("array<double>"))
    )
    return t.load(spark, sf, "embeddings").select("vec_id", vector.alias("vector"))


@query(
    "embedding_quality",
    """SELECT count(*) AS rows, count(*) FILTER (vec_id % 50 = 0) AS nan_rows,
       count(*) FILTER (vec_id % 50 <> 0 AND vec_id % 20 = 3) AS default_rows FROM embeddings""",
)
def embedding_quality(spark, sf):
    return r.vector_quality(mixed_vectors(spark, sf)).select("rows", "nan_rows", "default_rows")


@query(
    "embedding_norms",
    """SELECT count(*) AS rows, count(*) FILTER (vec_id % 50 = 0) AS nan_rows,
       count(*) FILTER (vec_id % 50 <> 0 AND length < 0.05) AS default_rows,
       round(avg(length) FILTER (vec_id % 50 <> 0), 6) AS norm_mean, round(stddev_pop(length) FILTER (vec_id % 50 <> 0), 6) AS norm_std
       FROM (SELECT vec_id, sqrt(list_dot_product(v, v)) AS length FROM (SELECT vec_id,
         list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 20 = 3 THEN x / 100 ELSE x END) AS v
         FROM embeddings))""",
)
def embedding_norms(spark, sf):
    measured = r.vector_quality(mixed_vectors(spark, sf))
    return measured.withColumns({n: F.round(n, 6) for n in ("norm_mean", "norm_std")})


SLOTS = """slots AS (SELECT user_id, 20 - c AS main_slots, c AS candidate_slots FROM (
  SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE greatest(0, least(20, CAST(round_even(20 * fraction, 0) AS BIGINT))) END AS c
  FROM (SELECT DISTINCT user_id, ((user_id % 33) / 40.0)::DOUBLE AS fraction FROM predictions)))"""


def user_slots(spark, sf):
    from tastemill.functions.numeric import model_slots

    users = t.predictions(spark, sf).select("user_id").distinct()
    slots = model_slots(F.lit(20), F.pmod("user_id", F.lit(33)) / F.lit(40.0), F.pmod("user_id", F.lit(4)) != 0)
    return users.select("user_id", slots.alias("s")).select("user_id", "s.main_slots", "s.candidate_slots")


@query("model_slots", with_(PREDICTIONS, SLOTS, select="SELECT * FROM slots"))
def model_slots_query(spark, sf):
    return user_slots(spark, sf)


MERGE_SQL = """scored AS (SELECT user_id, movie_id, 'main' AS model_role, max(score) AS predicted_score FROM predictions GROUP BY ALL
    UNION ALL SELECT user_id, movie_id, 'candidate', max(CASE WHEN movie_id % 3 = 0 THEN score ELSE 1 - score END) FROM predictions GROUP BY ALL),
  lists AS (SELECT *, row_number() OVER (PARTITION BY user_id, model_role ORDER BY predicted_score DESC, movie_id) AS rank FROM scored),
  picked AS (SELECT l.* FROM lists l JOIN slots USING (user_id)
    WHERE rank <= CASE WHEN model_role = 'main' THEN main_slots ELSE candidate_slots END),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, movie_id
    ORDER BY predicted_score DESC, model_role DESC) AS rn FROM picked) WHERE rn = 1)"""


@query(
    "model_merge",
    with_(PREDICTIONS, SLOTS, MERGE_SQL, select="""SELECT user_id, movie_id, model_role, round(predicted_score, 6) AS predicted_score, rank_position FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, model_role DESC, rank, movie_id) AS rank_position FROM kept)
      WHERE rank_position <= 20"""),
)
def model_merge(spark, sf):
    from pyspark.sql import Window

    rows = t.predictions(spark, sf)
    other = F.when(F.pmod("movie_id", F.lit(3)) == 0, F.col("score")).otherwise(1 - F.col("score"))
    both = rows.groupBy("user_id", "movie_id").agg(F.max("score").alias("main"), F.max(other).alias("candidate"))
    scored = both.select(
        "user_id",
        "movie_id",
        F.explode(F.create_map(F.lit("main"), F.col("main"), F.lit("candidate"), F.col("candidate"))).alias(
            "model_role", "predicted_score"
        ),
    )
    best = Window.partitionBy("user_id", "model_role").orderBy(F.col("predicted_score").desc(), "movie_id")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    merged = r.merge_model_rankings(ranked, user_slots(spark, sf), 20)
    return merged.withColumn("predicted_score", F.round("predicted_score", 6))

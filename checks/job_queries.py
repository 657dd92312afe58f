"""Composite jobs and model scoring on the test tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from checks import tables as t
from checks.dataset_queries import MAPPED, mapped
from checks.feature_queries import NORMS, STATS, stats
from checks.history_queries import LIKED
from checks.registry import query
from checks.retrieval_queries import GOOD, POOL
from checks.sql import CATALOG, CATALOG_GAPS, CF, CF_GAPS, CONTENT, CONTENT_GAPS, CREATED, FEEDBACK, LATEST, RATINGS, SPLIT, with_
from tastemill.models import encoder as en
from tastemill.models import factors as fa
from tastemill.models import ranker as ra
from tastemill.operators import features as ft
from tastemill.operators.vectors import norm
from tastemill.plans import recommend_jobs as rj
from tastemill.session import checkpoint_dir, staged
from tastemill.sources import datasets as ds


def fixed_layers(width: int, hidden: int) -> ra.Layers:
    """Small dense layers with weights from a formula."""
    i, j = np.arange(width)[:, None], np.arange(hidden)[None, :]
    first = ((i * 7 + j * 13) % 11 - 5) / 50.0
    second = ((np.arange(hidden)[:, None] * 3) % 5 - 1) / 4.0
    return [(first, (np.arange(hidden) % 3) / 10.0), (second, np.array([3.0]))]


@query(
    "mlp_scores",
    """WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS i FROM embeddings),
       h AS (SELECT vec_id, j, greatest(0, sum(v * (((i * 7 + j * 13) % 11 - 5) / 50.0::DOUBLE)) + (j % 3) / 10.0::DOUBLE) AS h
         FROM x, range(8) r(j) GROUP BY vec_id, j)
       SELECT vec_id, round(sum(h * (((j * 3) % 5 - 1) / 4.0::DOUBLE)) + 3.0, 6) AS prediction FROM h GROUP BY vec_id""",
)
def mlp_scores(spark, sf):
    rows = t.load(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    scored = ra.score_layers(rows, fixed_layers(64, 8))
    return scored.select("vec_id", F.round("prediction", 6).alias("prediction"))


@query(
    "cf_scores",
    with_(CREATED, CF, CONTENT, select="""SELECT id, round(list_dot_product(u.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS prediction
      FROM created c JOIN content u ON u.movie_id = c.user_id JOIN cf v ON v.movie_id = c.movie_id"""),
)
def cf_scores(spark, sf):
    pairs = t.created(spark, sf).select("id", F.col("user_id").alias("user_idx"), F.col("movie_id").alias("movie_idx"))
    users = t.content_vectors(spark, sf).select(F.col("movie_id").alias("user_idx"), F.col("vector").alias("user_factors"))
    movies = t.cf_vectors(spark, sf).select(F.col("movie_id").alias("movie_idx"), F.col("vector").alias("movie_factors"))
    scored = fa.score_factors(pairs, users, movies)
    return scored.select("id", F.round("prediction", 6).alias("prediction"))


@query(
    "snapshot_tables",
    with_(RATINGS, CATALOG, select="""SELECT 'ratings_events' AS name, count(*) AS rows, sum(id)::BIGINT AS ids, round(sum(rating), 6) AS total, count(DISTINCT user_id) AS keys FROM ratings
      UNION ALL SELECT 'catalog_movies', count(*), sum(movie_id)::BIGINT, round(sum(tmdb_popularity), 6), count(DISTINCT title) FROM catalog"""),
)
def snapshot_tables(spark, sf):
    """A snapshot is written, published and read back by its name."""
    from tastemill.plans.dataset_jobs import snapshot

    root, tables = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4()}", {"ratings_events": t.ratings(spark, sf), "catalog_movies": t.catalog(spark, sf)}
    snapshot(spark, tables, root, "s1", part_rows=5_000)
    stored = {name: ds.read_snapshot(spark, root, ds.latest_complete(spark, root), name) for name in tables}

    def summary(name: str, key: str, number: str, distinct: str):
        return stored[name].agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(key).alias("ids"), F.round(F.sum(number), 6).alias("total"),
            F.count_distinct(distinct).alias("keys"),
        ).select("name", "rows", "ids", "total", "keys")

    return summary("ratings_events", "id", "rating", "user_id").union(summary("catalog_movies", "movie_id", "tmdb_popularity", "title"))


@query(
    "cf_fit_quality",
    with_(MAPPED, select="""SELECT user_idx, count(*) AS ratings, true AS solved FROM mapped
      WHERE split = 'train' AND rating IS NOT NULL GROUP BY user_idx"""),
)
def cf_fit_quality(spark, sf):
    """Fit on the training split: every user's factors must solve their normal equations."""
    train = staged(mapped(spark, sf).where(F.col("rating").isNotNull() & (F.col("split") == "train")))
    found = fa.user_gradients(fa.fit_factors(train), train)
    solved = F.col("gradient") <= 1e-3 * (F.col("scale") + 1e-3)
    return found.select(F.col("user_idx").cast("bigint"), "ratings", solved.alias("solved"))


@query(
    "stale_text_embeddings",
    "SELECT doc_id AS movie_id, sha256(text) AS embedding_text_hash, 32::BIGINT AS width, 1.0::DOUBLE AS length FROM documents WHERE doc_id % 2 <> 0",
)
def stale_text_embeddings(spark, sf):
    """Unit-length hashed embeddings of the texts whose stored one is missing."""
    texts = t.load(spark, sf, "documents").select(F.col("doc_id").alias("movie_id"), "text")
    stored = texts.where(F.pmod("movie_id", F.lit(2)) == 0).select(
        "movie_id", F.array_repeat(F.lit(0.1).cast("float"), 32).alias("embedding"), F.sha2("text", 256).alias("embedding_text_hash")
    )
    fresh = en.embed_stale(texts, stored, 32, "v1")
    return fresh.select(
        "movie_id", "embedding_text_hash", F.size("embedding").cast("bigint").alias("width"), F.round(norm(F.col("embedding")), 5).alias("length")
    )


def model(spark, sf, version: str, shift: int) -> rj.RankingModel:
    width = ft.feature_dim(t.CONTENT_DIM, t.CF_DIM)
    layers = fixed_layers(width, 6 + shift)
    return rj.RankingModel(version, layers, t.cf_space(spark, sf))


# The liked genres of eligible users only; the bucket scores are not part of the result.
LIKED_READY = LIKED[LIKED.index("liked AS (") :].replace("FROM active a", "FROM ready a")
POOL_SQL = POOL.replace("scored AS (", "alike AS (").replace("FROM scored s", "FROM alike s")
RECOMMENDED = """ready AS (SELECT a.* FROM active a WHERE user_id IN (SELECT user_id FROM active GROUP BY user_id HAVING count(*) >= 5)),
  excluded AS (SELECT user_id, movie_id FROM ready),
  seed_texts AS (SELECT DISTINCT user_id, user_id || ':2024-02-01' AS text FROM ready),
  seed_steps(user_id, text, i, a, b) AS (SELECT user_id, text, 0, 1::BIGINT, 0::BIGINT FROM seed_texts
    UNION ALL SELECT user_id, text, i + 1, (a + ascii(substr(text, i + 1, 1))) % 65521,
      (b + (a + ascii(substr(text, i + 1, 1))) % 65521) % 65521 FROM seed_steps WHERE i < length(text)),
  seeds AS (SELECT user_id, (b * 65536 + a) % 2147483648 AS seed FROM seed_steps WHERE i = length(text)),
  user_dims AS (SELECT 'content' AS space, r.user_id, p.pos, sum(r.rating) AS weight, sum(coalesce(v.vector[p.pos], 0)::DOUBLE * r.rating) AS total
    FROM ready r CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) p LEFT JOIN content v USING (movie_id) GROUP BY ALL
    UNION ALL
    SELECT 'cf', r.user_id, p.pos, sum(r.rating), sum(coalesce(v.vector[p.pos], 0)::DOUBLE * r.rating)
    FROM ready r CROSS JOIN (SELECT unnest(range(1, 65)) AS pos) p LEFT JOIN cf v USING (movie_id) GROUP BY ALL),
  inputs AS (SELECT user_id, list(total / weight ORDER BY pos) FILTER (space = 'content') AS profile,
      list(total / weight ORDER BY pos) FILTER (space = 'cf') AS cf_profile FROM user_dims GROUP BY user_id),
  profiles AS (SELECT user_id, profile FROM inputs),
  behavior AS (SELECT user_id, [count(*)::DOUBLE, avg(rating), stddev_pop(rating), count(*) FILTER (rating >= 4)::DOUBLE,
      count(*) FILTER (rating <= 2)::DOUBLE] AS behavior FROM ready GROUP BY user_id)"""
DRAWS = f"""keyed AS (SELECT *, (m * ((m * 16807 + 12345) % 2147483647)) % 2147483647 AS draw FROM (
      SELECT f.*, (seed * 48271 + movie_id * 69621) % 2147483647 AS m FROM fresh f JOIN seeds USING (user_id))),
  my_drawn AS (SELECT * FROM (SELECT user_id, movie_id, row_number() OVER (PARTITION BY user_id ORDER BY draw, movie_id) AS rank FROM keyed) WHERE rank <= 75),
  tail_keyed AS (SELECT *, (m * ((m * 16807 + 12345) % 2147483647)) % 2147483647 AS draw FROM (
      SELECT n.*, (seed * 48271 + movie_id * 69621) % 2147483647 AS m FROM near n JOIN seeds USING (user_id)
      WHERE rank > 150 AND user_id NOT IN (SELECT user_id FROM liked))),
  my_tail AS (SELECT * FROM (SELECT user_id, movie_id, row_number() OVER (PARTITION BY user_id ORDER BY draw, movie_id) AS rank FROM tail_keyed) WHERE rank <= 75),
  buckets AS (SELECT user_id, movie_id, 'knn' AS retrieval_source, 0 AS p, rank FROM near WHERE rank <= 250
    UNION ALL SELECT user_id, movie_id, 'popular', 1, rank FROM popular UNION ALL SELECT user_id, movie_id, 'random_genre', 2, rank FROM my_drawn
    UNION ALL SELECT user_id, movie_id, 'random_knn', 3, rank FROM my_tail),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY p, rank) AS copy FROM buckets) WHERE copy = 1),
  pool AS (SELECT * FROM (SELECT user_id, movie_id, retrieval_source, row_number() OVER (PARTITION BY user_id ORDER BY p, rank, movie_id) AS pool_rank
    FROM kept) WHERE pool_rank <= 300),
  norms AS (SELECT movie_id, [{", ".join(f"({e})::DOUBLE" for e in NORMS.values())}] AS metadata FROM catalog, stats),
  joined AS (SELECT p.*, i.profile AS u, i.cf_profile AS w, b.behavior, n.metadata, coalesce(c.vector::DOUBLE[], z.zero) AS v, coalesce(f.vector::DOUBLE[], z.zero) AS x
    FROM pool p JOIN inputs i USING (user_id) JOIN behavior b USING (user_id) LEFT JOIN norms n USING (movie_id)
    LEFT JOIN content c USING (movie_id) LEFT JOIN cf f USING (movie_id), (SELECT list_resize([0.0::DOUBLE], 64, 0.0::DOUBLE) AS zero) z),
  features AS (SELECT user_id, movie_id, retrieval_source, pool_rank, list_concat(u, v, [cos_uv], list_transform(range(1, 65), lambda i: u[i] * v[i]),
      w, x, [cos_wx], list_transform(range(1, 65), lambda i: w[i] * x[i]), behavior, metadata) AS f
    FROM (SELECT *, CASE WHEN list_dot_product(u, u) * list_dot_product(v, v) > 0
        THEN list_dot_product(u, v) / sqrt(list_dot_product(u, u) * list_dot_product(v, v)) ELSE 0 END AS cos_uv,
      CASE WHEN list_dot_product(w, w) * list_dot_product(x, x) > 0
        THEN list_dot_product(w, x) / sqrt(list_dot_product(w, w) * list_dot_product(x, x)) ELSE 0 END AS cos_wx FROM joined)),
  models AS (SELECT * FROM (VALUES ('main', 6), ('candidate', 7)) m(model_role, hidden)),
  units AS (SELECT model_role, j, list(((i * 7 + j * 13) % 11 - 5) / 50.0::DOUBLE ORDER BY i) AS weights
    FROM models, range(396) a(i), range(7) b(j) WHERE j < hidden GROUP BY model_role, j),
  scored AS (SELECT user_id, movie_id, retrieval_source, pool_rank, model_role,
      sum(greatest(0, list_dot_product(f, weights) + (j % 3) / 10.0::DOUBLE) * (((j * 3) % 5 - 1) / 4.0::DOUBLE)) + 3.0 AS predicted_score
    FROM features, units GROUP BY ALL),
  listed AS (SELECT *, row_number() OVER (PARTITION BY user_id, model_role ORDER BY predicted_score DESC, pool_rank) AS rank FROM scored),
  picked AS (SELECT * FROM listed WHERE rank <= CASE WHEN model_role = 'main' THEN 14 ELSE 6 END),
  single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY predicted_score DESC, model_role DESC) AS copy FROM picked) WHERE copy = 1)"""


@query(
    "recommendations",
    with_(
        SPLIT, LATEST, "active AS (SELECT * FROM latest WHERE event_type = 'rating_created' AND rating IS NOT NULL)",
        CATALOG_GAPS, STATS, CONTENT_GAPS, CF_GAPS, RECOMMENDED, LIKED_READY, POOL_SQL, GOOD, DRAWS, recursive=True,
        select="""SELECT user_id, movie_id, rank_position, model_role, retrieval_source, round(predicted_score, 6) AS predicted_score FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, model_role DESC, rank, movie_id) AS rank_position FROM single)
          WHERE rank_position <= 20""",
    ),
)
def recommendations(spark, sf):
    """Ranked lists for every eligible user from two models (composite of operators checked on their own)."""
    main = model(spark, sf, "m1", 0)
    other = rj.RankingModel("c1", fixed_layers(ft.feature_dim(t.CONTENT_DIM, t.CF_DIM), 7), main.cf)
    listed = rj.recommend_batch(
        t.ratings(spark, sf), t.catalog_with_gaps(spark, sf), t.content_space(spark, sf),
        ft.stats_values(stats(spark, sf, t.catalog_with_gaps)), main, t.now(),
        candidate=other, candidate_fraction=0.3, experiment_id="exp-1",
    )
    return listed.select("user_id", "movie_id", "rank_position", "model_role", "retrieval_source", F.round("predicted_score", 6).alias("predicted_score"))


@query(
    "feedback_log",
    with_(FEEDBACK, select="SELECT experiment_id, model_role, count(*) AS ratings, round(sum(rating), 6) AS total FROM feedback GROUP BY ALL"),
)
def feedback_log(spark, sf):
    from tastemill.operators.experiment import append_log

    rows = t.feedback(spark, sf)
    log, new = rows.where(F.col("movie_id") < 50), rows.where(F.col("movie_id") >= 50)
    return append_log(log, new).groupBy("experiment_id", "model_role").agg(
        F.count(F.lit(1)).alias("ratings"), F.round(F.sum("rating"), 6).alias("total")
    )

"""Message validation, dead letters, idempotent insert, experiment feedback, health windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.function_queries import ISO, UUID_SQL, uuid_from
from checks.registry import query
from checks.sql import FEEDBACK, RATINGS, with_
from tastemill.functions import events as ev
from tastemill.operators import experiment as ex
from tastemill.operators import merge as m
from tastemill.session import staged
from tastemill.streaming import health

MESSAGES = RATINGS + f""", made AS (SELECT *, {UUID_SQL} AS made_id FROM (SELECT *,
    {uuid_from("'rating:' || user_id || ':' || movie_id || ':' || " + ISO.format('rating_timestamp') + " || ':' || coalesce(rating, 0.0::DOUBLE)")} AS d FROM ratings)),
  judged AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'json_decode_error' WHEN event_id % 19 = 0 THEN 'empty_payload'
      WHEN event_id % 23 = 0 AND event_type = 'rating_created' THEN 'validation_error' WHEN event_id % 23 = 0 THEN NULL
      WHEN event_id % 29 = 0 THEN 'validation_error' END AS error_type,
    CASE WHEN event_id % 23 = 0 THEN 'rating: invalid float' ELSE 'event_type: unknown rating_updated' END AS problem FROM made),
  messages AS (SELECT *, 0 AS copy FROM judged UNION ALL SELECT *, 1 FROM judged WHERE event_id % 31 = 0)"""


@query(
    "validate_events",
    with_(MESSAGES, select="""SELECT event_id AS key_id, copy, error_type,
      CASE WHEN error_type IS NULL THEN made_id END AS event_uuid, CASE WHEN error_type IS NULL THEN event_type END AS event_type,
      CASE WHEN error_type IS NULL THEN user_id END AS user_id, CASE WHEN error_type IS NULL THEN movie_id END AS movie_id,
      CASE WHEN error_type IS NULL THEN rating END AS rating,
      CASE WHEN error_type IS NULL THEN epoch_us(rating_timestamp) END AS rated_us FROM messages"""),
)
def validate_events(spark, sf):
    checked = ev.validate_events(t.rating_messages(spark, sf), "ratings")
    return checked.select(
        "key_id",
        F.pmod("offset", F.lit(2)).alias("copy"),
        "error_type",
        F.col("event.event_id").alias("event_uuid"),
        "event.event_type",
        "event.user_id",
        "event.movie_id",
        "event.rating",
        F.unix_micros("event.rating_timestamp").alias("rated_us"),
    )


@query(
    "dead_letters",
    with_(MESSAGES, select="""SELECT 'ratings-consumer' AS worker_name, 'ratings' AS source_topic, event_id % 4 AS kafka_partition,
      (event_id // 4) * 2 + copy AS kafka_offset, CASE WHEN error_type = 'validation_error' THEN made_id END AS event_id, error_type,
      CASE WHEN error_type = 'validation_error' THEN problem ELSE 'Could not decode JSON payload' END AS error_message
      FROM messages WHERE error_type IS NOT NULL"""),
)
def dead_letters(spark, sf):
    checked = ev.validate_events(t.rating_messages(spark, sf), "ratings")
    return ev.dead_letters(checked, "ratings-consumer").drop("raw_payload").withColumn(
        "kafka_partition", F.col("kafka_partition").cast("bigint")
    )


STORED = """, valid AS (SELECT * FROM messages WHERE error_type IS NULL), stored AS (SELECT made_id FROM valid WHERE event_id % 3 = 0),
  fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY made_id ORDER BY event_id % 4, (event_id // 4) * 2 + copy) AS rn FROM valid)
    WHERE rn = 1 AND made_id NOT IN (SELECT made_id FROM stored))"""


def checked_messages(spark, sf):
    """Validated messages, written once since several branches read them."""
    return staged(ev.validate_events(t.rating_messages(spark, sf), "ratings"))


@query(
    "dedup_events",
    with_(MESSAGES, select=STORED + " SELECT made_id AS event_id, event_type, user_id, movie_id, rating, event_id % 4 AS partition FROM fresh"),
)
def dedup_events(spark, sf):
    checked = checked_messages(spark, sf)
    rows = ev.valid_events(checked).select("event.*", "partition", "offset", "key_id")
    stored = rows.where(F.pmod("key_id", F.lit(3)) == 0).select("event_id")
    fresh = m.new_events(rows.drop("key_id"), stored, ["partition", "offset"])
    return fresh.select("event_id", "event_type", "user_id", "movie_id", "rating", F.col("partition").cast("bigint").alias("partition"))


@query(
    "ingest_status_counts",
    with_(MESSAGES, select=STORED + """ SELECT CASE WHEN m.error_type IS NOT NULL THEN 'validation_error' WHEN f.made_id IS NOT NULL THEN 'success'
      ELSE 'duplicate' END AS status, count(*) AS rows
      FROM messages m LEFT JOIN fresh f ON f.event_id = m.event_id AND f.copy = m.copy GROUP BY 1"""),
)
def ingest_status_counts(spark, sf):
    from tastemill.streaming.ingest import message_status

    checked = checked_messages(spark, sf)
    rows = ev.valid_events(checked).select("event.*", "partition", "offset", "key_id")
    stored = rows.where(F.pmod("key_id", F.lit(3)) == 0).select("event_id")
    return message_status(checked, stored).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- experiments

FOLD = FEEDBACK + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY rated_at, id) AS rn,
      count(*) FILTER (model_role = 'candidate') OVER w AS cand_n,
      avg(rating) FILTER (model_role = 'candidate') OVER w AS cand_avg
    FROM feedback WINDOW w AS (PARTITION BY experiment_id ORDER BY rated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  fold(experiment_id, rn, main, cand, challenged, promoted_id) AS (
    SELECT DISTINCT experiment_id, 0::BIGINT, 0.7::DOUBLE, 0.3::DOUBLE, true, NULL::BIGINT FROM ordered
    UNION ALL
    SELECT experiment_id, rn, CASE WHEN promote THEN 1.0::DOUBLE ELSE m2 END, CASE WHEN promote THEN 0.0::DOUBLE ELSE c2 END,
      challenged AND NOT promote, CASE WHEN promote THEN id ELSE promoted_id END FROM (
      SELECT *, challenged AND c2 >= 0.8::DOUBLE - 1e-9::DOUBLE AND cand_n >= 10 AND cand_avg >= 4.0 AS promote FROM (
        SELECT *, CASE WHEN d = 0 THEN main WHEN m1 + c1 <= 0 THEN 1.0::DOUBLE ELSE m1 / (m1 + c1) END AS m2,
               CASE WHEN d = 0 THEN cand WHEN m1 + c1 <= 0 THEN 0.0::DOUBLE ELSE c1 / (m1 + c1) END AS c2 FROM (
          SELECT *, CASE WHEN model_role = 'main' THEN x ELSE greatest(0.0::DOUBLE, least(0.8::DOUBLE, 1.0::DOUBLE - x)) END AS m1,
                 CASE WHEN model_role = 'main' THEN greatest(0.0::DOUBLE, least(0.8::DOUBLE, 1.0::DOUBLE - x)) ELSE x END AS c1 FROM (
            SELECT *, greatest(0.0::DOUBLE, least(0.8::DOUBLE, CASE WHEN model_role = 'main' THEN main ELSE cand END + d)) AS x FROM (
              SELECT o.experiment_id, o.rn, o.id, o.model_role, o.cand_n, o.cand_avg, f.main, f.cand, f.challenged, f.promoted_id,
                CASE WHEN o.rating >= 4.0 THEN 0.02::DOUBLE WHEN o.rating <= 3.0 THEN -0.02::DOUBLE ELSE 0.0::DOUBLE END AS d
              FROM fold f JOIN ordered o ON o.experiment_id = f.experiment_id AND o.rn = f.rn + 1)))))),
  states AS (SELECT f.*, o.cand_n, o.cand_avg FROM fold f JOIN ordered o USING (experiment_id, rn)
    WHERE rn = (SELECT count(*) FROM feedback b WHERE b.experiment_id = f.experiment_id))"""


def states(spark, sf):
    return ex.split_states(t.feedback(spark, sf))


@query(
    "split_policy_fold",
    with_(FOLD, recursive=True, select="""SELECT experiment_id, rn AS rows, cand_n AS candidate_ratings, round(coalesce(cand_avg, 0), 6) AS candidate_avg,
      round(main, 6) AS main_fraction, round(cand, 6) AS candidate_fraction, promoted_id IS NOT NULL AS promoted, promoted_id FROM states"""),
)
def split_policy_fold(spark, sf):
    return states(spark, sf).withColumns(
        {n: F.round(n, 6) for n in ("candidate_avg", "main_fraction", "candidate_fraction")}
    )


@query(
    "candidate_stats",
    with_(FEEDBACK, select="SELECT experiment_id, model_role, count(*) AS ratings, round(avg(rating), 6) AS average FROM feedback GROUP BY ALL"),
)
def candidate_stats(spark, sf):
    return ex.candidate_stats(t.feedback(spark, sf)).withColumn("average", F.round("average", 6))


@query(
    "experiment_counts",
    with_(FEEDBACK, select='SELECT experiment_id, model_role, count(*) AS "count" FROM feedback GROUP BY ALL'),
)
def experiment_counts(spark, sf):
    return ex.role_counts(t.feedback(spark, sf))


EXPERIMENTS = FEEDBACK + """, known AS (SELECT DISTINCT experiment_id, substr(experiment_id, 5)::INTEGER AS n FROM feedback),
  experiments AS (SELECT experiment_id, 'm0' AS main_model_version, CASE WHEN n % 2 = 0 THEN 'c0' END AS candidate_model_version,
    0.55::DOUBLE AS main_split_fraction, 0.45::DOUBLE AS candidate_split_fraction, CASE WHEN n = 3 THEN 'retired' ELSE 'active' END AS status
    FROM known WHERE n < 5),
  requests AS (SELECT experiment_id, n, 'm1' AS main_model_version, CASE WHEN n % 3 = 0 THEN 'c1' WHEN n % 3 = 1 THEN 'c0' END AS candidate_model_version FROM known)"""


def experiment_table(spark, sf):
    number = F.substring("experiment_id", 5, 10).cast("int")
    known = t.feedback(spark, sf).select("experiment_id").distinct()
    start = F.lit("2024-01-01").cast("timestamp")
    return known.where(number < 5).select(
        "experiment_id",
        F.lit("m0").alias("main_model_version"),
        F.when(F.pmod(number, F.lit(2)) == 0, "c0").alias("candidate_model_version"),
        F.lit(0.55).alias("main_split_fraction"),
        F.lit(0.45).alias("candidate_split_fraction"),
        F.when(number == 3, "retired").otherwise("active").alias("status"),
        start.alias("created_at"),
        start.alias("updated_at"),
    )


@query(
    "experiment_get_or_create",
    with_(EXPERIMENTS, select="""SELECT experiment_id,
      CASE WHEN fresh THEN r.main_model_version ELSE e.main_model_version END AS main_model_version,
      CASE WHEN fresh THEN r.candidate_model_version ELSE e.candidate_model_version END AS candidate_model_version,
      CASE WHEN fresh THEN 0.7 ELSE main_split_fraction END::DOUBLE AS main_split_fraction,
      CASE WHEN fresh THEN 0.3 ELSE candidate_split_fraction END::DOUBLE AS candidate_split_fraction, 'active' AS status
      FROM (SELECT r.experiment_id, e.experiment_id IS NULL OR e.status <> 'active' OR (r.candidate_model_version IS NOT NULL
        AND r.candidate_model_version IS DISTINCT FROM e.candidate_model_version) AS fresh
        FROM requests r LEFT JOIN experiments e USING (experiment_id)) JOIN requests r USING (experiment_id) LEFT JOIN experiments e USING (experiment_id)"""),
)
def experiment_get_or_create(spark, sf):
    number = F.pmod(F.substring("experiment_id", 5, 10).cast("int"), F.lit(3))
    asked = t.feedback(spark, sf).select("experiment_id").distinct().select(
        "experiment_id",
        F.lit("m1").alias("main_model_version"),
        F.when(number == 0, "c1").when(number == 1, "c0").alias("candidate_model_version"),
    )
    return ex.open_experiments(experiment_table(spark, sf), asked, t.now()).drop("created_at", "updated_at")


@query(
    "experiment_promotion",
    with_(EXPERIMENTS, select="""SELECT experiment_id, CASE WHEN hit THEN 'c9' ELSE main_model_version END AS main_model_version,
      CASE WHEN NOT hit THEN candidate_model_version END AS candidate_model_version,
      CASE WHEN hit THEN 1.0 ELSE main_split_fraction END::DOUBLE AS main_split_fraction,
      CASE WHEN hit THEN 0.0 ELSE candidate_split_fraction END::DOUBLE AS candidate_split_fraction
      FROM (SELECT *, substr(experiment_id, 5)::INTEGER % 2 = 0 AS hit FROM experiments)"""),
)
def experiment_promotion(spark, sf):
    table = experiment_table(spark, sf)
    hit = table.where(F.pmod(F.substring("experiment_id", 5, 10).cast("int"), F.lit(2)) == 0)
    promotions = hit.select("experiment_id", F.lit("c9").alias("new_main_version"))
    return ex.record_promotions(table, promotions, t.now()).drop("created_at", "updated_at", "status")


@query(
    "active_splits",
    with_(EXPERIMENTS, select="SELECT experiment_id, main_split_fraction, candidate_split_fraction FROM experiments WHERE status = 'active'"),
)
def active_splits(spark, sf):
    return ex.active_splits(experiment_table(spark, sf))


# ---------------------------------------------------------------- health windows


def observations(spark, sf):
    """Handled messages: worker, status and write latency."""
    return t.load(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("handled_at"),
        F.col("event_type").alias("worker"),
        F.when(F.pmod("event_id", F.lit(7)) == 0, "duplicate").otherwise("success").alias("status"),
        F.col("value").alias("latency_ms"),
    )


@query(
    "health_1m",
    """SELECT epoch_us(date_trunc('minute', ts)) AS window_us, event_type AS worker,
       CASE WHEN event_id % 7 = 0 THEN 'duplicate' ELSE 'success' END AS status, count(*) AS events, round(count(*) / 60.0, 6)::DOUBLE AS rate
       FROM events GROUP BY ALL""",
)
def health_1m(spark, sf):
    rates = health.event_rates(observations(spark, sf))
    return rates.select(F.unix_micros("window.start").alias("window_us"), "worker", "status", "events", F.round("rate", 6).alias("rate"))


SLIDING = """slid AS (SELECT e.*, epoch_us(date_trunc('minute', ts)) - i * 60000000 AS window_us FROM events e, range(5) r(i))"""


@query(
    "latency_percentiles_5m",
    with_(SLIDING, select="""SELECT window_us, event_type AS worker, count(*) AS events, quantile_disc(value, 0.5) AS p50,
      quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM slid GROUP BY ALL"""),
)
def latency_percentiles_5m(spark, sf):
    windows = health.latency_percentiles(observations(spark, sf), accuracy=1_000_000)
    return windows.select(F.unix_micros("window.start").alias("window_us"), "worker", "events", "p50", "p95", "p99")


@query(
    "error_ratio_5m",
    with_(SLIDING, select="""SELECT window_us, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors,
      round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS ratio FROM slid GROUP BY window_us"""),
)
def error_ratio_5m(spark, sf):
    requests = observations(spark, sf).withColumn("failed", F.col("worker") == "error")
    ratios = health.error_ratio(requests)
    return ratios.select(F.unix_micros("window.start").alias("window_us"), "requests", "errors", F.round("ratio", 6).alias("ratio"))


@query(
    "dead_letters_5m",
    with_(SLIDING, select="SELECT window_us, event_type AS worker, 'validation_error' AS error_type, count(*) AS letters FROM slid WHERE event_id % 7 = 0 GROUP BY ALL"),
)
def dead_letters_5m(spark, sf):
    letters = observations(spark, sf).where(F.col("status") == "duplicate").select(
        "handled_at", "worker", F.lit("validation_error").alias("error_type")
    )
    return health.dead_letter_counts(letters).select(
        F.unix_micros("window.start").alias("window_us"), "worker", "error_type", "letters"
    )

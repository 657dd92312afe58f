"""Rating and tag streams: validate, insert once, keep dead letters, apply tag side effects.

Each micro-batch is matched against the stored event ids through an index of their hashes (see
`tastemill.streaming.seen`), so a replay adds nothing and new ids open no stored event. Tables
are append-only Parquet folders partitioned by micro-batch: a batch that is run again
overwrites only its own folder. Tag counts are a published base and the changes of the batches
since, added up by readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastemill.functions.events import dead_letters, valid_events, validate_events
from tastemill.operators.merge import mark_dirty, new_events, sum_tag_counts, tag_counts
from tastemill.sources.datasets import child_names, newest_version, path_exists, read_current, write_version
from tastemill.streaming.seen import index_batch, known_among, prepare_index

WORKERS = {"ratings": "ratings-consumer", "tags": "tags-consumer"}
MESSAGE_SCHEMA = "value binary, topic string, partition int, offset bigint"


def kafka_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Messages of a topic from the earliest offset (needs the Kafka connector on the cluster)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", "earliest")
    return reader.options(**options).load().select("value", "topic", "partition", "offset")


def kafka_sink(events: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Publish (event_id, value) rows keyed by event id."""
    keyed = events.select(F.col("event_id").alias("key"), "value")
    writer = keyed.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("topic", topic).option("checkpointLocation", checkpoint).start()


def file_source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same four columns from JSON-lines files holding base64 values."""
    rows = spark.readStream.schema("value string, topic string, partition int, offset bigint")
    return (
        rows.option("maxFilesPerTrigger", files_per_batch)
        .json(path)
        .withColumn("value", F.unbase64("value"))
    )


def write_messages(df: DataFrame, path: str) -> None:
    """Store messages as JSON lines that `file_source` reads."""
    df.select(F.base64("value").alias("value"), "topic", "partition", "offset").write.mode("append").json(path)


def message_status(validated: DataFrame, stored: DataFrame) -> DataFrame:
    """Each message as validation_error, success (first copy of a new event) or duplicate.

    The first copy of a new event is found by aggregation and matched back by its message
    position, so an event repeated many times does not gather in one task.
    """
    place = ["topic", "partition", "offset"]
    good = valid_events(validated).select("event.event_id", *place)
    firsts = new_events(good, stored, ["partition", "offset"]).select(*place, F.lit("success").alias("status"))
    judged = good.join(firsts, place, "left").withColumn("status", F.coalesce("status", F.lit("duplicate")))
    bad = validated.where(F.col("error_type").isNotNull()).withColumn("status", F.lit("validation_error"))
    columns = [*place, "status"]
    return judged.select(columns).unionByName(bad.select(columns))


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _append_new(rows: DataFrame, keys: list[str], order: list[str], path: str, batch_id: int) -> None:
    """Store the rows whose key no other batch has stored; of equal keys the first in `order` (any, without one)."""
    index = f"{path}_index"
    prepare_index(rows.sparkSession, path, keys, index)
    known = known_among(rows, path, keys, index, batch_id)
    if order:
        fresh = new_events(rows, known, order)
    else:
        fresh = rows.dropDuplicates(keys).join(known, keys, "left_anti").select(*rows.columns)
    fresh = fresh.persist()
    try:
        index_batch(fresh, keys, index, batch_id)
        _write_batch(fresh, path, batch_id)
    finally:
        fresh.unpersist()


def ingest_batch(batch: DataFrame, batch_id: int, topic: str, root: str, catalog: DataFrame | None = None) -> None:
    """Write one micro-batch: new events, dead letters and, for tags, counts and dirty marks.

    Batch numbers continue where tables exist already; a number that is used again replaces that batch.
    """
    spark = batch.sparkSession
    checked = validate_events(batch, topic).persist()
    try:
        letters = dead_letters(checked, WORKERS[topic])
        _append_new(letters, ["source_topic", "kafka_partition", "kafka_offset"], [], f"{root}/dead_letter_events", batch_id)
        rows = valid_events(checked).select("event.*", "partition", "offset")
        event_path = f"{root}/{topic}_events"
        _append_new(rows, ["event_id"], ["partition", "offset"], event_path, batch_id)
        if topic == "tags":
            written = spark.read.parquet(f"{event_path}/batch_id={batch_id}")
            apply_tag_effects(written, root, batch_id, catalog)
    finally:
        checked.unpersist()


TAG_COUNTS = "movie_id bigint, tag string, count bigint, updated_at timestamp"
FOLD_COUNTS_EVERY = 32


def _count_changes(spark: SparkSession, path: str, after: int) -> DataFrame:
    """Changes of the batches that the base of this number does not hold."""
    if not path_exists(spark, f"{path}/changes"):
        return spark.createDataFrame([], f"{TAG_COUNTS}, batch_id bigint")
    return spark.read.schema(f"{TAG_COUNTS}, batch_id bigint").parquet(f"{path}/changes").where(F.col("batch_id") > after)


def current_tag_counts(spark: SparkSession, root: str) -> DataFrame:
    """Tag counts of all batches: the newest base and the changes since."""
    path = f"{root}/movie_tag_counts"
    base = read_current(spark, path, TAG_COUNTS)
    changes = _count_changes(spark, path, int(newest_version(spark, path) or -1))
    return sum_tag_counts(base.unionByName(changes.drop("batch_id")))


def add_count_changes(fresh: DataFrame, root: str, batch_id: int, fold_every: int = FOLD_COUNTS_EVERY) -> None:
    """Write a batch's own counts; after `fold_every` batches earlier ones become the next base.

    A base is named by the last batch in it. A batch that is run again replaces its own changes, and
    is left alone once a base holds it.
    """
    spark, path = fresh.sparkSession, f"{root}/movie_tag_counts"
    base = int(newest_version(spark, path) or -1)
    numbers = [int(name.split("=")[1]) for name in child_names(spark, f"{path}/changes", "batch_id=")]
    if batch_id <= base:
        if batch_id not in numbers:
            raise ValueError(f"batch {batch_id} comes after {base}: batch numbers must continue")
        return
    waiting = [n for n in numbers if base < n < batch_id]
    if len(waiting) >= fold_every:
        earlier = _count_changes(spark, path, base).where(F.col("batch_id") < batch_id).drop("batch_id")
        whole = sum_tag_counts(read_current(spark, path, TAG_COUNTS).unionByName(earlier))
        write_version(whole, path, f"{max(waiting):012d}")
    change = tag_counts(fresh).withColumn("updated_at", F.current_timestamp())
    _write_batch(change, f"{path}/changes", batch_id)


def apply_tag_effects(fresh: DataFrame, root: str, batch_id: int, catalog: DataFrame | None) -> None:
    """Tag counts and the next version of the dirty queue from the batch's new tag events.

    The queue's version is the batch id. A batch that is run again starts from the version before
    it, so nothing is added twice.
    """
    spark = fresh.sparkSession
    version = f"{batch_id:012d}"
    now = F.current_timestamp()
    add_count_changes(fresh, root, batch_id)
    if catalog is not None:
        dirty = read_current(
            spark,
            f"{root}/catalog_dirty_movies",
            "movie_id bigint, first_dirty_at timestamp, last_dirty_at timestamp, attempt_count bigint, last_error string",
            version,
        )
        known = fresh.select("movie_id").distinct().join(catalog.select("movie_id"), "movie_id", "left_semi")
        write_version(mark_dirty(dirty, known, now), f"{root}/catalog_dirty_movies", version)


def start_ingest(
    messages: DataFrame, topic: str, root: str, checkpoint: str, catalog: DataFrame | None = None, *, once: bool = True
) -> StreamingQuery:
    """Run the stream of one topic into the tables under `root`."""
    writer = messages.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, topic, root, catalog))
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def deduplicated_within(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Bounded-state alternative to the stored-id match: drops repeats seen within the watermark."""
    return events.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(["event_id"])

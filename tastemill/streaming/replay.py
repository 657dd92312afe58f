"""Incremental publishing of CSV rows as events; progress lives in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastemill.functions.events import event_json, ratings_to_events, tags_to_events
from tastemill.session import staged
from tastemill.sources.catalog_csv import RATINGS, TAGS, read_csv, stream_csv
from tastemill.sources.datasets import path_exists

_KINDS = {"ratings": (RATINGS, ratings_to_events), "tags": (TAGS, tags_to_events)}


def event_messages(events: DataFrame, topic: str) -> DataFrame:
    """(event_id, value, topic): JSON messages keyed by event id."""
    value = F.encode(event_json(events, events.columns), "UTF-8")
    return events.select("event_id", value.alias("value"), F.lit(topic).alias("topic"))


def csv_messages(spark: SparkSession, folder: str, topic: str, files_per_batch: int = 10) -> DataFrame:
    """Streaming messages of the CSV files in a folder; files already published are not read again."""
    schema, build = _KINDS[topic]
    rows = stream_csv(spark, folder, schema, files_per_batch)
    return event_messages(build(rows, F.current_timestamp()), topic)


def first_rows(spark: SparkSession, path: str, topic: str, limit: int) -> DataFrame:
    """A bounded test replay: the first `limit` rows of a file as messages."""
    schema, build = _KINDS[topic]
    return event_messages(build(read_csv(spark, path, schema).limit(limit), F.current_timestamp()), topic)


def publish_new_rows(spark: SparkSession, path: str, topic: str, target: str, checkpoint: str) -> int:
    """Publish the rows of CSV files that no earlier run has published; returns how many.

    Files may have grown since: progress is kept by row, as the ids of the published events, and
    not by file. A run that failed is repeated under its own batch number.
    """
    schema, build = _KINDS[topic]
    root = f"{checkpoint}/published"
    done = _published(spark, root)
    messages = event_messages(build(read_csv(spark, path, schema), F.current_timestamp()), topic)
    fresh = staged(messages.join(done, "event_id", "left_anti"))
    batch = (done.agg(F.max("batch")).first()[0] or 0) + 1
    count = fresh.count()
    if count:
        _write_messages(fresh, target, batch)
        # Only the new ids are written; earlier batches stay as they are.
        fresh.select("event_id").write.mode("overwrite").parquet(f"{root}/batch={batch}")
    return count


def _published(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the batches that ended; a batch without Spark's mark of success did not."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "event_id string, batch bigint")
    return spark.read.schema("event_id string, batch bigint").parquet(root)


def publish_to_files(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish to a folder of JSON lines, the file stand-in of a topic.

    Partition and offset follow the micro-batch and the row's place in it, so a batch that
    is repeated rewrites the same messages.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_messages(batch, path, batch_id)

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_messages(messages: DataFrame, path: str, batch: int) -> None:
    place = F.monotonically_increasing_id()
    rows = messages.select(
        F.base64("value").alias("value"),
        "topic",
        F.shiftright(place, 33).cast("int").alias("partition"),
        (F.lit(batch).cast("bigint") * F.lit(1 << 33) + place.bitwiseAND(F.lit((1 << 33) - 1))).alias("offset"),
    )
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")

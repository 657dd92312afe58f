"""Operational tables: partitioned reads from a database, run log, document publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.operators.documents import document_json
from tastemill.operators.history import latest_per_key
from tastemill.operators.merge import merge_tables
from tastemill.sources.datasets import path_exists, read_current, write_version

RUN_SCHEMA = (
    "run_id string, job_name string, status string, started_at timestamp, finished_at timestamp, "
    "records_processed bigint, records_failed bigint, code_version string, error_message string, logged_at timestamp"
)
DOCUMENT_SCHEMA = "movie_id bigint, document string, published_at timestamp"


def read_table(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .options(**options)
        .load()
    )


def log_run(spark: SparkSession, path: str, run_id: str, job_name: str, status: str, **values) -> None:
    """Append one state of a run: `running` at its start, a final status at its end."""
    row = {"run_id": run_id, "job_name": job_name, "status": status, **values}
    names = [f.split(" ")[0] for f in RUN_SCHEMA.split(", ")]
    frame = spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA)
    now = F.current_timestamp()
    stamped = frame.withColumn("logged_at", now)
    if status == "running":
        stamped = stamped.withColumn("started_at", F.coalesce("started_at", now))
    else:
        stamped = stamped.withColumn("finished_at", F.coalesce("finished_at", now))
    stamped.write.mode("append").parquet(path)


def pipeline_runs(spark: SparkSession, path: str) -> DataFrame:
    """Latest state per run; the start time comes from its first row."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA)
    rows = spark.read.schema(RUN_SCHEMA).parquet(path)
    started = rows.groupBy("run_id").agg(F.min("started_at").alias("__start"))
    latest = latest_per_key(rows, ["run_id"], ["logged_at"])
    joined = latest.join(started, "run_id").withColumn("started_at", F.coalesce("started_at", "__start"))
    return joined.drop("__start").select(*rows.columns)


def document_errors(documents: DataFrame, dim: int) -> DataFrame:
    """Documents that cannot be published, with the reason."""
    reason = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title is missing").when(
        F.coalesce(F.size("content_embedding"), F.lit(-1)) != dim, "embedding has the wrong width"
    )
    return documents.select("movie_id", reason.alias("error")).where(F.col("error").isNotNull())


def publish_documents(documents: DataFrame, root: str, version: str, dim: int, now: Column, *, rebuild: bool = False) -> DataFrame:
    """Upsert documents by movie into the next version of the document table.

    Returns one outcome row per document (movie_id, succeeded, error). A rebuild starts from
    an empty table; readers switch over when the version is published.
    """
    spark = documents.sparkSession
    errors = document_errors(documents, dim)
    good = documents.join(errors.select("movie_id"), "movie_id", "left_anti")
    fresh = document_json(good).withColumn("published_at", now)
    base = spark.createDataFrame([], DOCUMENT_SCHEMA) if rebuild else read_current(spark, root, DOCUMENT_SCHEMA, version)
    written = {"document": F.col("change.document"), "published_at": F.col("change.published_at")}
    write_version(merge_tables(base, fresh, ["movie_id"], written, written), root, version)
    return documents.select("movie_id").join(errors, "movie_id", "left").select(
        "movie_id", F.col("error").isNull().alias("succeeded"), "error"
    )

"""Which keys of a micro-batch are stored already, without reading the stored keys themselves.

Beside an append-only table lies an index of it: one 64-bit hash and batch number per row. A
published base holds the sorted hashes of old batches, a folder per batch those written since.
After `FOLD_EVERY` batches they become the next base, so a batch reads the base and at most that
many small folders, however many batches there were. Equal hashes only name the batches in which
a key may lie; whether it does is read there, from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.session import broadcast_if_small
from tastemill.sources.datasets import child_names, newest_version, path_exists, write_version

FOLD_EVERY = 8
# More batches than this are not listed in a filter; the whole table is read instead.
MOST_LISTED = 1_000
HASH, BATCH = "key_hash", "batch_id"
SCHEMA = f"{HASH} bigint, {BATCH} bigint"
# Sorted hashes are stored as differences, in about half of their eight bytes.
PACKED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


def _key_hash(keys: list[str]):
    return F.xxhash64(*[F.col(k).cast("string") for k in keys]).alias(HASH)


def _recent(root: str, base: str | None) -> str:
    return f"{root}/recent/after={base or 'none'}"


def seen_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(key_hash, batch_id) of all indexed rows."""
    base = newest_version(spark, root)
    recent = _recent(root, base)
    parts = [f"{root}/version={base}/data"] if base else []
    parts += [recent] if path_exists(spark, recent) else []
    found = spark.createDataFrame([], SCHEMA)
    for part in parts:
        found = found.unionByName(spark.read.schema(SCHEMA).parquet(part))
    return found


def prepare_index(spark: SparkSession, table: str, keys: list[str], root: str) -> None:
    """Build the index of a stored table that has none, or fold its recent batches into the next base.

    The folders of recent batches are named after the base that they follow: a fold that was
    published leaves none, and one that was not is repeated. Old folders are never read again.
    """
    base = newest_version(spark, root)
    recent = _recent(root, base)
    if base is None and not path_exists(spark, recent):
        if not path_exists(spark, table):
            return
        rows = spark.read.parquet(table).select(_key_hash(keys), F.col(BATCH).cast("bigint").alias(BATCH))
    elif len(child_names(spark, recent, "batch_id=")) >= FOLD_EVERY:
        rows = seen_hashes(spark, root).distinct()
    else:
        return
    ordered = rows.repartitionByRange(HASH).sortWithinPartitions(HASH)
    write_version(ordered, root, f"{int(base or 0) + 1:012d}", **PACKED)


def index_batch(fresh: DataFrame, keys: list[str], root: str, batch_id: int) -> None:
    """Index the rows of a batch. Done before they are stored, so no stored row lacks its hash."""
    base = newest_version(fresh.sparkSession, root)
    rows = fresh.select(_key_hash(keys)).sort(HASH)
    rows.write.mode("overwrite").options(**PACKED).parquet(f"{_recent(root, base)}/{BATCH}={batch_id}")


def known_among(batch: DataFrame, table: str, keys: list[str], root: str, batch_id: int) -> DataFrame:
    """Keys of the batch that other batches than `batch_id` have stored in the table's folder.

    The asked keys are sent to the hashes while they are few enough, so the index is not shuffled;
    of the table only the folders of batches with an equal hash are listed and read. Keys must not
    be null.
    """
    spark = batch.sparkSession
    asked = batch.select(*keys).distinct().withColumn(HASH, _key_hash(keys))
    others = seen_hashes(spark, root).where(F.col(BATCH) != batch_id)
    hits = others.join(broadcast_if_small(asked, 96), HASH).select(BATCH).distinct()
    batches = sorted(r[0] for r in hits.limit(MOST_LISTED + 1).collect())
    # A batch that failed between its index and its rows has no folder.
    folders = [f"{table}/{BATCH}={b}" for b in batches]
    folders = [table] if len(batches) > MOST_LISTED else [f for f in folders if path_exists(spark, f)]
    if not folders:
        return batch.select(*keys).limit(0)
    stored = spark.read.option("basePath", table).parquet(*folders).where(F.col(BATCH) != batch_id)
    return stored.select(*keys).join(broadcast_if_small(asked.select(*keys), 96), keys, "left_semi").distinct()

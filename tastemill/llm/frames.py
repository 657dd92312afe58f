"""Small helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.session import ship_package, use_utc

# Texts vary from a few bytes to megabytes: both limits together bound a worker's memory.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables, with the package and batch size set up for Python workers."""
    small_batches(spark)
    return ship_package(use_utc(spark)).read.parquet(f"{sf}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes that reach a Python worker at once; the settings belong to the session."""
    for name, limit in BATCH_LIMITS.items():
        if spark.conf.get(name, None) != limit:
            spark.conf.set(name, limit)
    return ship_package(spark)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model learns from; a null id counts as the text ''."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def label_sample(labels: DataFrame, column: str, most: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most `most` rows of each label outside the held-out fold, and all rows per label.

    Rows are taken in the order of a hash of their id, so reruns agree; rows with a null id or
    label are left out. The sample has at most twice `most` rows and is marked for broadcast.
    """
    known = ~held_out() & F.col(column).isNotNull() & F.col("doc_id").isNotNull()
    chosen = labels.where(known).select("doc_id", (F.col(column) != 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    part = lambda label: chosen.where(F.col("label") == label).orderBy(turn, "doc_id").limit(most)
    return F.broadcast(part(0).union(part(1))), counts


def spare_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """A 64-bit value of a row's columns; with the id it tells rows apart that share an id."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


# Columns that only live inside an operator; the marks keep them apart from a table's own columns.
ROW_KEY, PAIR_ID, PAIR_KEY = "__row_key", "__pair_id", "__pair_key"


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.withColumn(ROW_KEY, row_key(*columns))


def pairs(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id and row_key of `rows` under the names that `same_row` joins on."""
    return rows.select(F.col("doc_id").alias(PAIR_ID), F.col("row_key").alias(PAIR_KEY), *more)


def same_row(docs: DataFrame, decided: DataFrame) -> Column:
    """Equal id (null equals null) and equal row key of `keyed` documents and `pairs`."""
    return docs["doc_id"].eqNullSafe(decided[PAIR_ID]) & (docs[ROW_KEY] == decided[PAIR_KEY])


def each_once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """`keyed` documents with one row for each of the `pairs` in `repeated`.

    Only rows that are repeated pass a shuffle of their own.
    """
    again = docs.join(repeated, same_row(docs, repeated), "left_semi").dropDuplicates(["doc_id", ROW_KEY])
    return docs.join(repeated, same_row(docs, repeated), "left_anti").unionByName(again)

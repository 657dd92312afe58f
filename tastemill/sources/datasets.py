"""Versioned Parquet datasets: data first, then a JSON manifest that makes the version visible."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETE = "complete"


# ---------------------------------------------------------------- small files through the Hadoop file system


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def child_names(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names under a folder that start with `prefix`; none where there is no folder."""
    fs, target = _file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(n for n in names if n.startswith(prefix))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a temporary name and rename it, so readers never see half of it."""
    fs, target = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.tmp")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(kind, 1)
    overwrite[0] = kind.OVERWRITE
    # One step, so that readers find either the old file or the new one.
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, overwrite)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


# ---------------------------------------------------------------- manifests


def utc_now() -> str:
    return datetime.now(tz=UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def commit_dataset(spark: SparkSession, root: str, version: str, details: dict) -> str:
    """Publish a written version: its manifest is the last file."""
    path = f"{root}/version={version}/manifest.json"
    manifest = {"version": version, "status": COMPLETE, "finished_at": utc_now(), **details}
    write_text(spark, path, json.dumps(manifest, indent=2))
    return path


MANIFEST_HEAD = "version string, status string"


def manifests(spark: SparkSession, root: str, schema: str = MANIFEST_HEAD) -> DataFrame:
    """All readable manifests under `root`, one row each; broken ones are skipped."""
    pattern = f"{root}/version=*/manifest.json"
    if not path_exists(spark, root) or not _any_manifest(spark, root):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema)
    return reader.json(pattern).where(F.col("version").isNotNull())


def _any_manifest(spark: SparkSession, root: str) -> bool:
    fs, target = _file_system(spark, f"{root}/version=*/manifest.json")
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def latest_complete(spark: SparkSession, root: str, override: str | None = None) -> str:
    """Newest complete version, or the override when that is complete."""
    complete = manifests(spark, root).where(F.col("status") == COMPLETE)
    if override:
        if complete.where(F.col("version") == override).isEmpty():
            raise ValueError(f"version {override} under {root} is not complete")
        return override
    found = complete.agg(F.max("version")).first()[0]
    if found is None:
        raise ValueError(f"no complete version under {root}")
    return found


def load_manifest(spark: SparkSession, root: str, version: str) -> dict:
    return json.loads(read_text(spark, f"{root}/version={version}/manifest.json"))


def check_lineage(expected: dict[str, str], *manifest_rows: tuple[str, dict]) -> list[tuple[str, str, str, str]]:
    """(dataset, field, expected, found) for every manifest field that disagrees."""
    wrong = []
    for name, manifest in manifest_rows:
        for field, value in expected.items():
            if field in manifest and manifest[field] != value:
                wrong.append((name, field, str(value), str(manifest[field])))
        if manifest.get("status") != COMPLETE:
            wrong.append((name, "status", COMPLETE, str(manifest.get("status"))))
    return wrong


def require_lineage(expected: dict[str, str], *manifest_rows: tuple[str, dict]) -> None:
    wrong = check_lineage(expected, *manifest_rows)
    if wrong:
        raise ValueError("; ".join(f"{n}: {f} is {got}, expected {want}" for n, f, want, got in wrong))


# ---------------------------------------------------------------- current tables


def write_version(df: DataFrame, root: str, version: str, **options: str) -> None:
    """Write the next version of a maintained table and publish it."""
    spark = df.sparkSession
    df.write.mode("overwrite").options(**options).parquet(f"{root}/version={version}/data")
    commit_dataset(spark, root, version, {})


def newest_version(spark: SparkSession, root: str, before: str | None = None) -> str | None:
    """Name of the newest published version (older than `before`, if given)."""
    complete = manifests(spark, root).where(F.col("status") == COMPLETE)
    if before is not None:
        complete = complete.where(F.col("version") < before)
    return complete.agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, root: str, schema: str, before: str | None = None) -> DataFrame:
    """Newest published version (older than `before`, if given), or an empty table."""
    found = newest_version(spark, root, before)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/version={found}/data")


# ---------------------------------------------------------------- parts


def export_ordered(df: DataFrame, path: str, keys: list[str], part_rows: int = 50_000) -> None:
    """Parts in key order: ranges across files, sorted within, at most `part_rows` rows each."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", part_rows).parquet(path)


def write_numbered_parts(df: DataFrame, path: str) -> None:
    """Write rows that carry `part_idx` as one folder per part.

    Rows of a part are neighbours already (the rank was computed in order), so no further
    shuffle is needed; a part at a slice border has two files.
    """
    df.write.mode("overwrite").partitionBy("part_idx").parquet(path)


def write_feature_parts(df: DataFrame, path: str, part_rows: int = 100_000) -> None:
    """Feature rows by split, at most `part_rows` rows per file; ratings are stored as float."""
    writer = df.withColumn("rating", F.col("rating").cast("float")).write.mode("overwrite")
    writer.option("maxRecordsPerFile", part_rows).partitionBy("split").parquet(path)


DIGEST_CHUNK = 8 * 1024 * 1024


def file_digests(files: DataFrame, chunk_bytes: int = DIGEST_CHUNK) -> DataFrame:
    """(path, sha256) of whole files, listed with their length.

    Files are dealt to tasks and read there chunk by chunk, so a task holds one chunk whatever a
    file's size. Paths are opened by pyarrow's file systems. Spark's listing skips empty files.
    """

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            paths, out = part.column("path").to_pylist(), []
            for path, length in zip(paths, part.column("length").to_pylist(), strict=True):
                system, name = FileSystem.from_uri(path)
                digest, read = hashlib.sha256(), 0
                with system.open_input_stream(name) as source:
                    while chunk := source.read(chunk_bytes):
                        digest.update(chunk)
                        read += len(chunk)
                if read != length:
                    raise OSError(f"{path}: {read} bytes read, {length} listed")
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.string())], names=["path", "sha256"])

    return files.select("path", "length").mapInArrow(digests, "path string, sha256 string")


def part_inventory(spark: SparkSession, path: str, chunk_bytes: int = DIGEST_CHUNK) -> DataFrame:
    """(object_key, row_count, sha256) of every Parquet file below `path`."""
    rows = (
        spark.read.option("recursiveFileLookup", True)
        .parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("object_key"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    digests = file_digests(listed.load(path).select("path", "length"), chunk_bytes)
    # Both sides name files with different scheme slashes; compare the bare path.
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    found = digests.withColumn("bare", bare(F.col("path")))
    joined = rows.withColumn("bare", bare(F.col("object_key"))).join(found, "bare", "right")
    return joined.select(
        F.col("path").alias("object_key"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "sha256"
    )


def read_parts(spark: SparkSession, parts: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*parts)


def read_snapshot(spark: SparkSession, root: str, version: str, table: str, schema: str | None = None) -> DataFrame:
    """All parts of one table of a snapshot."""
    return read_parts(spark, [f"{root}/version={version}/{table}"], schema)

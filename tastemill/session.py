"""Session defaults and the few settings the operators read from the session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size limits for data handed to every executor.
BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
ROWS_PER_SLICE_CONF = "tastemill.rowsPerSlice"
DEFAULT_ROWS_PER_SLICE = 1_000_000
FREE_SHUFFLES_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "tastemill", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with UTC time, AQE and Arrow; a cluster's own settings stay untouched."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC; epoch conversions depend on it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application.

    Workers do not share the driver's import path; a cluster with the package installed
    merely gets the same files again.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tastemill-package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


_shipped: set[str] = set()


def rows_per_slice(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_SLICE_CONF, str(DEFAULT_ROWS_PER_SLICE)))


def is_local(master: str) -> bool:
    """True where driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tastemill-"))
    return context.getCheckpointDir()


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a result that several branches read, as a table in the shared folder, and read it back.

    Lineage ends there, counts come from file footers, and each branch reads only its own
    columns (and partitions).
    """
    path = f"{checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4()}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(FREE_SHUFFLES_CONF, None)
    spark.conf.set(FREE_SHUFFLES_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES_CONF)
        else:
            spark.conf.set(FREE_SHUFFLES_CONF, before)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work when the input came in fewer pieces than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the counted size fits; otherwise leave the join to AQE."""
    cap = limit_bytes // max(1, row_bytes)
    if fits(df, cap):
        return F.broadcast(df)
    return df


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most `max_rows` rows."""
    return df.count() <= max_rows

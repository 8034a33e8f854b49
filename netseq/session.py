"""Session helpers: a local session for tests and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A table of a few narrow columns is hinted for broadcast only when its row count is known and at
# most this (some tens of megabytes).
BROADCAST_ROWS = 1_000_000

# The same for a single BIGINT column.
NARROW_BROADCAST_ROWS = 4_000_000


# Rows that one task of a dealt shuffle gets on average, so that what it sorts stays far below a task's memory.
TASK_ROWS = 500_000


# The JVM does not compile methods of more than 8000 bytes; wide tables make longer ones, which then
# run an order of magnitude slower than the smaller methods Spark generates without stage fusion.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tune(spark: SparkSession) -> None:
    """Keep generated code of wide tables compilable; a limit below the JVM's is left alone."""
    key, limit = METHOD_LIMIT
    if int(spark.conf.get(key, "65535")) > int(limit):
        spark.conf.set(key, limit)


def local_session(cpus: int | None = None, app: str = "netseq") -> SparkSession:
    """Session for tests and the bench; a cluster supplies its own."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(*METHOD_LIMIT)
        .getOrCreate()
    )


# Folders made for local sessions that name none, by application id.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Without that setting a temporary folder is made, but only for a local master; it is the same for all
    calls of one application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    key = spark.sparkContext.applicationId
    if key not in _local_folders:
        _local_folders[key] = tempfile.mkdtemp(prefix="netseq-")
    return _local_folders[key]


def staging_path(spark: SparkSession, label: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_folder(spark)}/netseq/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor re-reads files instead of repeating the sort before them,
    and values that depend on task layout (partition ids) are frozen.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many tasks as its ``n_rows`` rows need, whatever the session's number.

    Joins, groups and windows over the same keys then use this shuffle. Up to TASK_ROWS rows are left to the session.
    """
    if n_rows <= TASK_ROWS:
        return df
    session = df.sparkSession
    usual = int(session.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n_rows // TASK_ROWS), min(usual, 4 * session.sparkContext.defaultParallelism))
    return df.repartition(parts, *keys)


def small_side(df: DataFrame, n_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a join side of known size; beyond ``limit`` the optimiser decides."""
    return df.hint("broadcast") if n_rows <= limit else df

"""Session helpers: the shared folder of the cluster, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# A table whose plan size is at most this many bytes may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# How Spark writes the files of a checkpoint.
CHECKPOINTS = "spark.sql.streaming.checkpointFileManagerClass"
PLAIN_CHECKPOINTS = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"

_staged: list[str] = []


def local_session(app: str = "millrace", cores: str = "8", **conf: str) -> SparkSession:
    """Session for tests and the benchmark. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the one the cluster names, or a fresh one where none is set in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """Path of a new, unused folder under the shared one."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, purpose: str = "staged") -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, and lets later passes read only the columns
    they need instead of deriving all of them again.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, purpose)
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged() -> int:
    """Delete the tables this program has staged, once nothing derived from them is needed any more."""
    dropped = 0
    while _staged:
        store, root = file_store(_staged.pop())
        store.delete_dir(root)
        dropped += 1
    return dropped


@contextmanager
def shuffles_of(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Streams started inside keep ``partitions`` shuffle partitions, and so partitions of state, for as long as they run.

    For states of few groups: each partition costs a task and a file in every micro-batch, whether it holds a group or not.
    """
    with _set(spark, "spark.sql.shuffle.partitions", partitions):
        yield


@contextmanager
def plain_checkpoints(spark: SparkSession, path: str) -> Iterator[None]:
    """Streams started inside write their checkpoint, at the qualified ``path``, by Spark's plainer way where that is on a local disk. It
    renames each file into place too.

    The default one starts several programs there for each of the two files of a micro-batch. A way that the session names stays.
    """
    named = spark.conf.get(CHECKPOINTS, None)
    if named is None and path.startswith("file:") and spark._jvm.org.apache.spark.util.Utils.classIsLoadable(PLAIN_CHECKPOINTS):
        named = PLAIN_CHECKPOINTS
    with _set(spark, CHECKPOINTS, named):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value) -> Iterator[None]:
    """A setting of the session as long as this goes on; None leaves it unset."""
    before = spark.conf.get(name, None)
    try:
        if value is not None:
            spark.conf.set(name, value)
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a table scan over all cores where its files give fewer tasks than there are cores.

    For scans in front of costly row work. A table of many files is passed on as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def local_path(path: str) -> str:
    """Plain path of a ``file:`` URI; other schemes pass unchanged."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path if "://" in path else os.path.abspath(path)


def file_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path on it, usable on the driver and in tasks."""
    return fs.FileSystem.from_uri(local_path(path))

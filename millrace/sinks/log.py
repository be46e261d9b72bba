"""Append-only logs written from streams, safe against a micro-batch that runs twice."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.files import qualified
from millrace.session import file_store
from millrace.sinks.compact import read_compacted


def append_log(rows: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """Rows of one micro-batch under its own folder; a second run of it replaces the first."""
    rows.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/batch_id={batch_id}")


def put_rows(rows: pa.Table, path: str) -> None:
    """A small file of rows that the driver holds, without a job; it appears whole, in place of one of the same name."""
    store, name = file_store(path)
    folder, _, base = name.rpartition("/")
    store.create_dir(folder, recursive=True)
    # Spark's readers pass over names that begin so.
    temporary = f"{folder}/_{base}"
    pq.write_table(rows, temporary, filesystem=store)
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(name).type != fs.FileType.NotFound:
        store.delete_file(name)
    store.move(temporary, name)


def append_rows(spark: SparkSession, rows: pa.Table, path: str, run_id: str, batch_id: int) -> None:
    """``append_log`` for the few rows of a micro-batch that the driver holds already; one file, without a job."""
    folder = f"{qualified(spark, path)}/run_id={run_id}/batch_id={batch_id}"
    store, root = file_store(folder)
    for left in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        # Of a first run whose rows a job has written.
        if left.type == fs.FileType.File and left.base_name != "rows.parquet":
            store.delete_file(left.path)
    put_rows(rows, f"{folder}/rows.parquet")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a log, merged (``compact_log``) or not."""
    return read_compacted(spark, qualified(spark, path), schema)


def latest(log: DataFrame, keys: list[str], run_id: str | None = None) -> DataFrame:
    """Newest row per key of a log of updates of one run; without ``run_id`` the log holds only one."""
    if run_id is not None:
        log = log.where(F.col("run_id") == run_id)
    rest = [c for c in log.columns if c not in {*keys, "batch_id", "run_id"}]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])

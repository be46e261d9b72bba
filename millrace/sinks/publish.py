"""Publishing shards so that a reader sees each one whole or not at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import CAP_BYTES, DONE_NAME
from millrace.functions.columns import is_leftover, is_publishable
from millrace.operators.batching import pack_shards
from millrace.session import file_store, stage
from millrace.sources.raw import list_files


def publish_shards(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Typed shards, one folder and one file per shard, committed by rename.

    All rows of a shard meet in one task, so each shard is one file and appears at once.
    """
    (
        df.select("sample_id", "pos_in_shard", "x", "y", "shard_id")
        .repartition("shard_id")
        .sortWithinPartitions("shard_id", "pos_in_shard")
        .write.mode(mode)
        .option("maxRecordsPerFile", 0)
        .partitionBy("shard_id")
        .parquet(path)
    )


def _raw_writer(path: str, cap: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(path)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard_id")[i].as_py()
                x = batch.column("x").slice(i, 1).flatten().flatten().to_numpy(zero_copy_only=False)
                y = batch.column("y").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                words = np.concatenate([x, y]).astype("<i8")
                if not 0 < words.nbytes < cap:
                    raise ValueError(f"shard {shard} has {words.nbytes} bytes, allowed are 1 to {cap - 1}")
                # Attempts of a task do not share a temporary name, and each ends in the same final file.
                final = f"{root}/shard_{shard}.pt"
                temporary = f"{root}/shard_{shard}.{attempt}.pt.tmp"
                with store.open_output_stream(temporary) as out:
                    out.write(words.tobytes())
                store.move(temporary, final)
                yield pa.RecordBatch.from_pydict({"shard_id": [shard], "bytes": [words.nbytes]})

    return write


def publish_raw_shards(df: DataFrame, path: str, cap: int = CAP_BYTES) -> DataFrame:
    """Raw shard files, rows first and then labels; each is renamed into place by the task that wrote it.

    A shard of ``cap`` bytes or more is refused, which bounds what one task packs. Returns the stored
    publish log ``shard_id, bytes``.
    """
    written = pack_shards(df).mapInArrow(_raw_writer(path, cap), "shard_id bigint, bytes bigint")
    return stage(written, "publish-log")


def publishable_now(pending: DataFrame, present: DataFrame, lookahead: int) -> DataFrame:
    """Pending shards that may appear: shard ``i`` only once shard ``i - lookahead`` is gone.

    A shard that is still to come counts as not gone, so at most ``lookahead`` shards can be there at
    once. Both inputs have ``shard_id``; 0 means no limit.
    """
    if lookahead == 0:
        return pending
    there = present.select("shard_id").unionByName(pending.select("shard_id"))
    blocking = there.select((F.col("shard_id") + lookahead).alias("shard_id"))
    return pending.join(blocking, "shard_id", "left_anti")


def make_folder(path: str) -> None:
    """Create a shard folder, so that a reader may be started before the first shard is there."""
    store, root = file_store(path)
    store.create_dir(root, recursive=True)


def end_of_stream(path: str) -> None:
    """Empty end marker, written after the last shard."""
    make_folder(path)
    store, root = file_store(path)
    with store.open_output_stream(f"{root}/{DONE_NAME}"):
        pass


def stream_ended(spark: SparkSession, path: str) -> bool:
    """True once the marker is there and no shard is left; the marker is then taken away."""
    store, root = file_store(path)
    done = f"{root}/{DONE_NAME}"
    if store.get_file_info(done).type == fs.FileType.NotFound:
        return False
    if not list_files(spark, path).where(is_publishable(F.col("name"))).isEmpty():
        return False
    store.delete_file(done)
    return True


def _deleter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = 0
        for path in batch.column("path").to_pylist():
            store, name = file_store(path)
            # Missing is fine: the task may have run before.
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
                gone += 1
        yield pa.RecordBatch.from_pydict({"gone": pa.array([gone], pa.int64())})


def delete_files(paths: DataFrame) -> int:
    """Delete the files named in ``path``, spread over the executors; returns how many."""
    spread = paths.select("path").repartition(F.col("path"))
    return spread.mapInArrow(_deleter, "gone bigint").agg(
        F.coalesce(F.sum("gone"), F.lit(0)).alias("n")
    ).first()["n"]


def purge_leftovers(spark: SparkSession, path: str, strict: bool = True) -> int:
    """Clear shards and end marker of an earlier run; returns how many files went."""
    return delete_files(list_files(spark, path).where(is_leftover(F.col("name"), strict)))


def retire_consumed(spark: SparkSession, path: str, consumed: DataFrame) -> int:
    """Delete the files of shards that ``consumed`` (``shard_id``) has safely recorded.

    Works on raw folders and on typed ones, where the shard number is in the folder's name.
    """
    files = list_files(spark, path, recursive=True)
    folder = F.regexp_extract("path", r"/shard_id=(\d+)/[^/]*\.parquet$", 1)
    number = F.when(folder != "", folder.cast("bigint")).when(
        is_publishable(F.col("name")), F.col("shard_id")
    )
    shards = files.select("path", number.alias("shard_id"))
    return delete_files(shards.join(consumed.select("shard_id").distinct(), "shard_id", "left_semi"))

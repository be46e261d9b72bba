"""Raw shard files: little-endian int64 words, the block of rows first, then the block of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import SHARD_GLOB, FeedConfig
from millrace.functions.columns import (
    clamp_labels,
    clamp_tokens,
    is_publishable,
    reshape_words,
    shard_index,
)
from millrace.schemas import BINARY_FILE
from millrace.session import file_store


def _with_scheme(scheme: str, path: str) -> str:
    """Path of a file as its folder was named. Object stores list paths that begin with the bucket."""
    if not scheme:
        return path
    bucket = scheme.split("://")[1]
    rest = path.removeprefix(f"{bucket}/") if bucket else path
    return f"{scheme}/{rest.lstrip('/')}"


def _lister(recursive: bool):
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                store, root = file_store(folder)
                found = store.get_file_info(fs.FileSelector(root, recursive=recursive))
                files = [f for f in found if f.type == fs.FileType.File]
                # A file keeps the scheme of its folder, so that it is opened on the same file system.
                scheme = folder.split("://")[0] + "://" + folder.split("://")[1].split("/")[0] if "://" in folder else ""
                for at in range(0, len(files), 4096):
                    part = files[at : at + 4096]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "folder": [folder] * len(part),
                            "file": [_with_scheme(scheme, f.path) for f in part],
                            "length": [f.size for f in part],
                        }
                    )

    return names


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, name, shard_id, length`` of every file in a folder, empty ones such as the end marker too.

    Spark's own file sources leave empty files out. No content is read.
    """
    folders = spark.createDataFrame([(path,)], "folder string")
    files = folders.mapInArrow(_lister(recursive), "folder string, file string, length bigint")
    name = F.element_at(F.split("file", "/"), -1)
    return files.select(
        F.col("file").alias("path"), name.alias("name"), shard_index(name).alias("shard_id"), "length"
    )


def empty_shards(spark: SparkSession, path: str) -> DataFrame:
    """Finished shard files without content, which no reader sees, as rejects."""
    files = list_files(spark, path).where(is_publishable(F.col("name")) & (F.col("length") == 0))
    return files.select("shard_id", "length", F.lit("empty").alias("reason"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # One file at a time: a batch of Arrow rows may hold thousands of files.
        for i in range(batch.num_rows):
            content = batch.column("content")[i].as_buffer()
            words = np.frombuffer(content, dtype="<i8", count=content.size // 8)
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays(
                [row.column("shard_id"), row.column("length"), listed],
                names=["shard_id", "length", "words"],
            )


def decode_raw(files: DataFrame) -> DataFrame:
    """``shard_id, length, words`` from binary-file rows; a trailing part of a word is ignored."""
    name = F.element_at(F.split("path", "/"), -1)
    shards = files.where(is_publishable(name)).select(
        shard_index(name).alias("shard_id"), "length", "content"
    )
    return shards.mapInArrow(_decode, "shard_id bigint, length bigint, words array<bigint>")


def read_raw_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every finished shard file of a folder; files under a temporary name are not seen."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", SHARD_GLOB).load(path)
    return decode_raw(files)


def stream_raw_shards(
    spark: SparkSession, path: str, max_in_flight: int | None = None, retire: bool = False
) -> DataFrame:
    """Finished shard files as a stream, at most ``max_in_flight`` of them per micro-batch.

    ``retire`` has the source delete files of earlier, committed micro-batches.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", SHARD_GLOB)
    if max_in_flight:
        reader = reader.option("maxFilesPerTrigger", max_in_flight)
    if retire:
        reader = reader.option("cleanSource", "delete")
    return decode_raw(reader.load(path))


def shape_raw(raw: DataFrame, config: FeedConfig) -> tuple[DataFrame, DataFrame]:
    """(packed shards with clamped words, rejects with a reason) at the agreed row length.

    The number of samples follows from the file's length; a length that does not fit is rejected.
    """
    n = F.floor(F.size("words") / F.lit(config.seq_len + 1))
    fits = (F.col("length") > 0) & (F.col("length") % config.sample_bytes == 0)
    shaped = raw.where(fits).select(
        "shard_id", reshape_words(F.col("words"), n, config.seq_len).alias("s")
    )
    packed = shaped.select(
        "shard_id",
        F.transform("s.x", lambda row: clamp_tokens(row, config.vocab)).alias("x"),
        F.transform("s.y", lambda y: clamp_labels(y, config.classes)).alias("y"),
    )
    rejected = raw.where(~fits).select("shard_id", "length", F.lit("length").alias("reason"))
    return packed, rejected

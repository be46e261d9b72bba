"""Typed shards: Parquet, one folder per shard, one file in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schemas import SAMPLE


def read_shards(spark: SparkSession, path: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """All published samples. A filter on ``shard_id`` prunes to the folders of those shards."""
    return spark.read.schema(schema).parquet(path)


def stream_shards(
    spark: SparkSession,
    path: str,
    max_in_flight: int | None = None,
    schema: T.StructType = SAMPLE,
    retire: bool = False,
) -> DataFrame:
    """Shards as a stream, at most ``max_in_flight`` of them per micro-batch.

    A shard is one file, so a bound on files is a bound on shards; without it a micro-batch takes all
    that are there. ``retire`` has the source delete files of earlier, committed micro-batches.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "false")
    if max_in_flight:
        reader = reader.option("maxFilesPerTrigger", max_in_flight)
    if retire:
        reader = reader.option("cleanSource", "delete")
    return reader.parquet(path)


def in_shard_order(df: DataFrame) -> DataFrame:
    """Rows of a micro-batch by shard number, then place. The file source orders by time only."""
    return df.orderBy("shard_id", F.col("pos_in_shard"))

"""Generated shards. Content depends on (seed, shard, row, place) only, so any one can be made again alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import STALL_S, FeedConfig
from millrace.functions.columns import once, whole_div


def _number(text: Column, bound: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % bound


def uniform_samples(rows: DataFrame, config: FeedConfig, seed: int) -> DataFrame:
    """Random row and label for every (shard_id, pos_in_shard) of ``rows``.

    The value at place ``i`` is drawn from the text ``seed:shard:pos:i``, the label from ``seed:shard:pos:y``.
    """
    parts = [F.col(c).cast("string") for c in ("shard_id", "pos_in_shard")]
    prefix = F.concat_ws(":", F.lit(str(seed)), *parts, F.lit(""))
    places = F.sequence(F.lit(0), F.lit(config.seq_len - 1))
    x = once(
        prefix,
        lambda p: F.transform(places, lambda i: _number(F.concat(p, i.cast("string")), config.vocab)),
    )
    return rows.withColumns({"x": x, "y": _number(F.concat(prefix, F.lit("y")), config.classes)})


def rows_of(manifest: DataFrame, n: str = "n_samples") -> DataFrame:
    """One row per sample slot of each shard of a manifest, spread for the work of filling them.

    A manifest is small, so its rows tend to meet in few tasks; the slots they stand for are many.
    """
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias("pos_in_shard")
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        manifest.where(F.col(n) > 0)
        .select("shard_id", slots)
        .repartition(tasks, "shard_id", "pos_in_shard")
    )


def synth_uniform(
    spark: SparkSession, num_shards: int, shard_size: int, config: FeedConfig, seed: int = 0
) -> DataFrame:
    """``num_shards`` shards of random samples, generated in parallel."""
    ids = spark.range(num_shards * shard_size)
    slots = ids.select(
        whole_div(F.col("id"), shard_size).alias("shard_id"),
        F.pmod(F.col("id"), F.lit(shard_size).cast("bigint")).alias("pos_in_shard"),
        F.col("id").alias("sample_id"),
    )
    return uniform_samples(slots, config, seed).select(
        "shard_id", "sample_id", "pos_in_shard", "x", "y"
    )


def fill_word(batch: Column) -> Column:
    """The int64 word whose eight bytes all are the low byte of the batch number."""
    low = batch.cast("bigint").bitwiseAND(F.lit(255).cast("bigint"))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(low, 8 * i) for i in range(8)])


def fill_batches(batches: DataFrame, batch_size: int, seq_len: int) -> DataFrame:
    """Words of each batch (``shard_id``): every byte is the low byte of its number."""
    size = batch_size * (seq_len + 1)
    return batches.select(
        "shard_id",
        F.lit(8 * size).cast("bigint").alias("length"),
        F.array_repeat(fill_word(F.col("shard_id")), size).alias("words"),
    )


def synth_fill(spark: SparkSession, n_batches: int, batch_size: int, seq_len: int) -> DataFrame:
    """Batches that can be told apart end to end, as raw words."""
    return fill_batches(spark.range(n_batches).withColumnRenamed("id", "shard_id"), batch_size, seq_len)


def with_stall(log: DataFrame, stall_s: float = STALL_S) -> DataFrame:
    """Shard log of a starved run: the stall counts as waiting, not as loading.

    ``wait_s`` grows by the stall; ``host_s``, which contains it, becomes ``load_s`` without it.
    """
    load = F.greatest(F.lit(0.0), F.col("host_s") - F.lit(stall_s))
    return log.withColumns({"wait_s": F.col("wait_s") + F.lit(stall_s), "load_s": load})


def stalled_samples(manifest: DataFrame, config: FeedConfig, seed: int) -> DataFrame:
    """Same shards and sizes as ``manifest``, random content in place of the published one."""
    return uniform_samples(rows_of(manifest), config, seed)


def paced_source(spark: SparkSession, config: FeedConfig, seed: int = 0, partitions: int = 1) -> DataFrame:
    """Stream of generated samples, exactly one shard of ``batch_size`` rows per micro-batch.

    The interval is the trigger of the query that reads it.
    """
    rate = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", config.batch_size)
        .option("numPartitions", partitions)
        .load()
    )
    slots = rate.select(
        whole_div(F.col("value"), config.batch_size).alias("shard_id"),
        F.pmod(F.col("value"), F.lit(config.batch_size).cast("bigint")).alias("pos_in_shard"),
        F.col("value").alias("sample_id"),
    )
    return uniform_samples(slots, config, seed).select(
        "shard_id", "sample_id", "pos_in_shard", "x", "y"
    )

"""Ordering, numbering and packing of samples into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import PAD, WORD_BYTES
from millrace.functions.columns import whole_div
from millrace.operators.ordered import dense_index


def order_shards(df: DataFrame) -> DataFrame:
    """Shards with their 1-based ``rank`` by integer id, so that 10 comes after 2."""
    ranked = dense_index(df, ["shard_id"], "rank")
    return ranked.withColumn("rank", F.col("rank") + 1)


def next_shard(df: DataFrame, by: str) -> DataFrame:
    """The waiting row of lowest id in each stream; partial aggregation, no sort."""
    rest = [c for c in df.columns if c != by]
    lowest = df.groupBy(by).agg(F.min_by(F.struct(*rest), F.col("shard_id")).alias("next"))
    return lowest.select(by, *[F.col(f"next.{c}").alias(c) for c in rest])


def assign_shards(
    df: DataFrame, order: list[str], batch_size: int
) -> DataFrame:
    """Number the rows in ``order`` and cut them into shards of ``batch_size`` consecutive rows.

    Adds ``sample_id`` (0, 1, 2, ...), ``shard_id`` and ``pos_in_shard``.
    """
    numbered = dense_index(df, order, "sample_id")
    return numbered.withColumns(
        {
            "shard_id": whole_div(F.col("sample_id"), batch_size),
            "pos_in_shard": F.pmod(F.col("sample_id"), F.lit(batch_size).cast("bigint")),
        }
    )


def shuffle_within_shard(df: DataFrame, seed: int) -> DataFrame:
    """Samples of each shard in a random order fixed by ``seed``: adds the 1-based ``rn``.

    The window is over one shard, which is never larger than the batch size.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string")))
    order = Window.partitionBy("shard_id").orderBy(draw, "sample_id")
    return df.withColumn("rn", F.row_number().over(order).cast("bigint"))


def minibatches(df: DataFrame, batch_size: int) -> DataFrame:
    """Cut each shuffled shard into minibatches; the last short one is kept."""
    return df.withColumn("minibatch", whole_div(F.col("rn") - 1, batch_size))


def pack_shards(df: DataFrame) -> DataFrame:
    """One row per shard: the block of rows and the block of labels, positions aligned."""
    rows = F.sort_array(F.collect_list(F.struct("pos_in_shard", "x", "y")))
    packed = df.groupBy("shard_id").agg(rows.alias("rows"))
    return packed.select("shard_id", F.col("rows.x").alias("x"), F.col("rows.y").alias("y"))


def unpack_shards(df: DataFrame) -> DataFrame:
    """One row per sample again; row i of ``x`` goes with label i."""
    pairs = F.posexplode(F.arrays_zip("x", "y")).alias("pos_in_shard", "pair")
    return df.select("shard_id", pairs).select(
        "shard_id",
        F.col("pos_in_shard").cast("bigint").alias("pos_in_shard"),
        F.col("pair.x").alias("x"),
        F.col("pair.y").alias("y"),
    )


def shard_manifest(df: DataFrame, n_tokens=None) -> DataFrame:
    """Per shard: samples, bytes on the wire, real tokens and positive labels.

    ``n_tokens`` is the column to sum for real tokens; by default words other than padding are counted.
    """
    tokens = F.size(F.filter("x", lambda t: t != PAD)) if n_tokens is None else n_tokens
    return df.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(tokens.cast("bigint")).alias("n_tokens"),
        F.sum((F.size("x").cast("bigint") + 1) * WORD_BYTES).alias("n_bytes"),
        F.sum("y").cast("bigint").alias("n_pos"),
    )

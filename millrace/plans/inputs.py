"""How the given tables become feed inputs: samples, batches, file names and logs.

Every input covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.functions.columns import fixed_rows, token_ids
from millrace.operators.batching import assign_shards
from millrace.operators.joins import label_join
from millrace.session import spread, stage

CONFIG = FeedConfig()
RUN_START = "2024-01-01"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_BATCH = 1000
STREAM_ORDER = ["ts_us", "event_id"]
PHASE_OF = {"click": "wait", "error": "load", "purchase": "pin", "signup": "h2d", "view": "train"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``, spread over the cores because every text is about to be cut into tokens."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("y"))
    return label_join(documents(spark, sf_dir), labels, "doc_id")


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, y`` of every document; y is null where there is no label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("y"))
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


def doc_rows(spark: SparkSession, sf_dir: str, config: FeedConfig = CONFIG, labelled: bool = True) -> DataFrame:
    """``doc_id, part, x, y, n_tokens``: whole documents, by default the labelled ones, as rows of fixed length."""
    source = labelled_documents if labelled else all_documents
    docs = source(spark, sf_dir).select(
        "doc_id", "y", token_ids(F.col("text"), config.vocab).alias("tokens")
    )
    rows = docs.select(
        "doc_id",
        "y",
        F.size("tokens").cast("bigint").alias("_n"),
        F.posexplode(fixed_rows(F.col("tokens"), config.seq_len, config.pad)).alias("part", "x"),
    )
    left = F.col("_n") - F.col("part") * config.seq_len
    return rows.select(
        "doc_id",
        F.col("part").cast("bigint").alias("part"),
        "x",
        "y",
        F.least(left, F.lit(config.seq_len)).cast("bigint").alias("n_tokens"),
    )


def doc_shards(spark: SparkSession, sf_dir: str, config: FeedConfig = CONFIG, labelled: bool = True) -> DataFrame:
    """Document rows numbered in (doc_id, part) order and cut into shards.

    The rows are staged: numbering passes over the keys, and must not tokenize all texts again.
    """
    rows = stage(doc_rows(spark, sf_dir, config, labelled), "doc-rows")
    return assign_shards(rows, ["doc_id", "part"], config.batch_size)


def line_shards(spark: SparkSession, sf_dir: str, batch_size: int = LINE_BATCH) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity")
    return assign_shards(lines, LINE_KEY, batch_size)


def line_batches(spark: SparkSession, sf_dir: str, batch_size: int = LINE_BATCH) -> DataFrame:
    """``shard_id, n, sample_size``: one row per batch of line items, with sizes from none to too large."""
    batches = line_shards(spark, sf_dir, batch_size).groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return batches.withColumn(
        "sample_size", F.pmod(F.col("shard_id") * 37, F.lit(512).cast("bigint")) * 8
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of a shard folder, with finished, unfinished, foreign and end-marker files."""
    s = F.col("shard_id")
    name = (
        F.when(s % 7 == 0, F.lit("DONE"))
        .when(s % 11 == 0, F.concat(F.lit("shard_"), s.cast("string"), F.lit(".bin")))
        .when(s % 5 == 0, F.concat(F.lit("shard_"), s.cast("string"), F.lit(".pt.tmp")))
        .otherwise(F.concat(F.lit("shard_"), s.cast("string"), F.lit(".pt")))
    )
    ids = line_batches(spark, sf_dir).select("shard_id")
    return ids.select(F.col("shard_id").alias("file_no"), name.alias("name"))


def micros(ts: str) -> F.Column:
    start = F.lit(RUN_START).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, F.col(ts))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream, event_id, shard_id, ts_us, service_us, bytes, n, correct``: one stream per user."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    samples = F.col("event_id") % 64 + 1
    return events.select(
        F.col("user_id").alias("stream"),
        "event_id",
        F.col("event_id").alias("shard_id"),
        micros("ts").alias("ts_us"),
        F.round(F.col("value") * 60000000).cast("bigint").alias("service_us"),
        (samples * 8200).alias("bytes"),
        samples.alias("n"),
        (F.col("event_id") % samples).alias("correct"),
    )


def phase_log_of(events: DataFrame) -> DataFrame:
    """``run, shard_id, phase, ms`` out of event rows, batch or stream."""
    phase = F.lit(None).cast("string")
    for kind, name in PHASE_OF.items():
        phase = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(phase)
    return events.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("shard_id"),
        phase.alias("phase"),
        F.col("value").alias("ms"),
    )


def phase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase_log_of(table(spark, sf_dir, "events"))


def shard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide shard log: one row per event, its value under the phase of its type, all else 0."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    n = F.col("event_id") % 64 + 1
    return events.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("shard_id"),
        F.col("ts"),
        (n * 8200).alias("bytes"),
        *[
            F.when(F.col("event_type") == kind, F.col("value")).otherwise(F.lit(0.0)).alias(f"{p}_ms")
            for kind, p in PHASE_OF.items()
        ],
        ((F.col("event_id") % 100) / 100.0).alias("loss"),
        (F.col("event_id") % n).alias("correct"),
        n.alias("n"),
    )


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, loss, n, prediction, y`` per labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return label_join(docs, labels, "doc_id").select(
        "source",
        ((F.col("n_chars") % 100) / 100.0).alias("loss"),
        (F.col("doc_id") % 7 + 1).alias("n"),
        F.col("toxic").cast("bigint").alias("prediction"),
        F.col("quality").cast("bigint").alias("y"),
    )


def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("token"), F.col("embedding").alias("vec")
    )


def order_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, word``: wide-ranging integers, some below zero."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 7919 - 50000000).alias("word"))


def fixed_weights(vocab: int):
    """Weight of a token for class k: a fixed multiple of 1/1024, so sums of it are exact."""

    def weight(token, k: int):
        digits = F.conv(F.substring(F.md5(F.concat(token.cast("string"), F.lit(f":{k}"))), 1, 8), 16, 10)
        return (digits.cast("bigint") % 2001 - 1000) / 1024.0

    return weight

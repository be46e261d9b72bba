"""Queries that publish the document shards and read them back, as tables and as streams.

Each runs over all labelled documents and returns the final table, so the rows can be compared.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.files import qualified
from millrace.operators.batching import unpack_shards
from millrace.plans import inputs
from millrace.plans.figures import held
from millrace.plans.inputs import CONFIG, phase_log_of
from millrace.plans.registry import DOC_SAMPLES, HELD, PHASE_LOG, query
from millrace.plans.shaping import SAMPLE_SUMS_SQL, r6, sample_sums
from millrace.plans.training import TRAIN_FILE_BYTES, TRAINED
from millrace.session import fresh_dir, shuffles_of
from millrace.sinks.log import append_log, append_rows, put_rows
from millrace.sinks.publish import end_of_stream, publish_raw_shards, publish_shards
from millrace.sinks.store import create_store, publish, publish_few, publish_written, store_ended, write_few
from millrace.sources.raw import list_files, read_raw_shards, shape_raw
from millrace.sources.store import index_of, read_raw_store, read_store, shards_between
from millrace.sources.typed import read_shards
from millrace.streaming import bounded
from millrace.streaming.bounded import hold_back
from millrace.streaming.feed import (
    PHASE_COLUMNS,
    consume_store,
    drain_store,
    keep_metrics,
    phase_log_handler,
    phase_metrics,
    publish_paced,
    run_stream,
    run_until_end,
    shard_log_handler,
    sweep_store,
    training_handler,
)

IN_FLIGHT = 4
RAW_IN_FLIGHT = 16
LOOKAHEAD = 3
# Files of changes a micro-batch takes, and a delay that no change of the given tables exceeds.
CHANGE_FILES = 4
ALL_TIME = "3650 days"
STATE_PARTS_A_CORE = 4
STREAM_CONFIG = FeedConfig(batch_size=256)
# Raw shards stay under the byte cap.
RAW_CONFIG = FeedConfig(batch_size=128)
FEED_LOG = "shard_id bigint, n bigint, bytes bigint, token_sum bigint, n_pos bigint, run_id string, batch_id bigint"


def published(spark: SparkSession, sf_dir: str, config: FeedConfig = CONFIG) -> str:
    path = fresh_dir(spark, "shards")
    publish_shards(inputs.doc_shards(spark, sf_dir, config), path)
    return path


def stored(spark: SparkSession, sf_dir: str, config: FeedConfig = CONFIG, kind: str = "typed") -> str:
    """A store with the document shards in indexed files."""
    path = create_store(spark, fresh_dir(spark, "store"), kind)
    publish(inputs.doc_shards(spark, sf_dir, config), path, kind)
    return path


def to_publish(spark: SparkSession, sf_dir: str, config: FeedConfig) -> tuple[DataFrame, Callable[[int, int], DataFrame]]:
    """The document shards kept to be published bit by bit: (all of them, those from one number to another), the latter from just the
    files that hold them."""
    path = create_store(spark, fresh_dir(spark, "to-publish"))
    publish(inputs.doc_shards(spark, sf_dir, config), path, file_bytes=TRAIN_FILE_BYTES)
    return read_store(spark, path), lambda low, high: read_store(spark, path, low, high)


@query("raw_round_trip", SAMPLE_SUMS_SQL)
def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published as raw words, read back, shaped and unpacked."""
    path = fresh_dir(spark, "raw")
    publish_raw_shards(inputs.doc_shards(spark, sf_dir), path)
    end_of_stream(path)
    packed, _ = shape_raw(read_raw_shards(spark, path), CONFIG)
    return sample_sums(unpack_shards(packed))


@query("typed_round_trip", SAMPLE_SUMS_SQL)
def typed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published into indexed files and read back."""
    return sample_sums(read_store(spark, stored(spark, sf_dir)))


@query("folder_round_trip", SAMPLE_SUMS_SQL)
def folder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published as a folder per shard and read back."""
    return sample_sums(read_shards(spark, published(spark, sf_dir)))


@query("raw_store_round_trip", SAMPLE_SUMS_SQL)
def raw_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published as raw words, many shards in a file, read back by the index, shaped and unpacked."""
    packed, _ = shape_raw(read_raw_store(spark, stored(spark, sf_dir, kind="raw")), CONFIG)
    return sample_sums(unpack_shards(packed))


@query(
    "store_index",
    f"WITH {DOC_SAMPLES} SELECT sample_id // 64 AS shard_id, count(*) AS n, (count(*) * 8200)::BIGINT AS bytes, "
    "1::BIGINT AS version, 1::BIGINT AS files FROM samples GROUP BY 1",
)
def store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a store: a row per shard, and in how many files a shard lies."""
    path = stored(spark, sf_dir)
    files = read_store(spark, path).groupBy("shard_id").agg(F.count_distinct("_metadata.file_path").alias("files"))
    return index_of(spark, path).join(files, "shard_id").select("shard_id", "n", "bytes", "version", "files")


def _log_sql(size: int, extra: str) -> str:
    return (
        f"WITH {DOC_SAMPLES}, t AS (SELECT sample_id // {size} AS shard_id, sum(token)::BIGINT AS token_sum "
        f"FROM tokens GROUP BY 1), s AS (SELECT sample_id // {size} AS shard_id, count(*) AS n, "
        "(count(*) * 8200)::BIGINT AS bytes, sum(y)::BIGINT AS n_pos FROM samples GROUP BY 1) "
        f"SELECT s.shard_id, n, bytes, coalesce(token_sum, 0) AS token_sum, n_pos{extra} "
        "FROM s LEFT JOIN t ON t.shard_id = s.shard_id"
    )


def _drained(spark: SparkSession, sf_dir: str, in_flight: int | None, retire: bool = False):
    shards = stored(spark, sf_dir, STREAM_CONFIG)
    run_dir = qualified(spark, fresh_dir(spark, "feed"))
    handler = shard_log_handler(f"{run_dir}/log", "run")
    drain_store(spark, shards, run_dir, handler, max_in_flight=in_flight, retire=retire)
    return shards, spark.read.schema(FEED_LOG).parquet(f"{run_dir}/log")


LOG_COLUMNS = ["shard_id", "n", "bytes", "token_sum", "n_pos"]


@query("stream_log", _log_sql(256, ""))
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per shard, one shard per micro-batch."""
    return _drained(spark, sf_dir, 1)[1].select(*LOG_COLUMNS)


@query("stream_bounded", _log_sql(256, ", true AS within_bound"))
def stream_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ``IN_FLIGHT`` shards per micro-batch."""
    log = _drained(spark, sf_dir, IN_FLIGHT)[1]
    taken = log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("taken"))
    within = F.col("taken") <= IN_FLIGHT
    return log.join(taken, "batch_id").select(*LOG_COLUMNS, within.alias("within_bound"))


@query("stream_flush", _log_sql(256, ", 0::BIGINT AS batch_id"))
def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards that are there in one micro-batch."""
    return _drained(spark, sf_dir, None)[1].select(*LOG_COLUMNS, "batch_id")


@query("stream_ordered", _log_sql(256, ", row_number() OVER (ORDER BY s.shard_id) AS place"))
def stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which shards are taken, one per micro-batch, as recorded while they are taken."""
    shards = stored(spark, sf_dir, STREAM_CONFIG)
    run_dir = qualified(spark, fresh_dir(spark, "feed"))
    log = shard_log_handler(f"{run_dir}/log", "run", few=True)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The shard of a micro-batch lies in one file and so in one partition, whose log rows are here.
        shards_taken = log(batch, batch_id)["shard_id"]
        place = pa.array([batch_id + 1] * len(shards_taken), pa.int64())
        append_rows(spark, pa.table({"shard_id": shards_taken, "place": place}), f"{run_dir}/places", "run", batch_id)

    drain_store(spark, shards, run_dir, handle, max_in_flight=1)
    rows = spark.read.schema(FEED_LOG).parquet(f"{run_dir}/log")
    places = spark.read.schema("shard_id bigint, place bigint").parquet(f"{run_dir}/places")
    return rows.join(places, "shard_id").select(*LOG_COLUMNS, "place")


@query("stream_retired", _log_sql(256, ", 0::BIGINT AS files_left, 0::BIGINT AS shards_left"))
def stream_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are deleted once all their shards are logged; nothing is left in the end."""
    shards, log = _drained(spark, sf_dir, IN_FLIGHT, retire=True)
    sweep_store(spark, shards)
    files = list_files(spark, f"{shards}/data", recursive=True)
    left = files.where(F.col("name").endswith(".parquet")).count()
    held = index_of(spark, shards).count()
    return log.select(*LOG_COLUMNS, F.lit(left).cast("bigint").alias("files_left"), F.lit(held).cast("bigint").alias("shards_left"))


@query("stream_raw", SAMPLE_SUMS_SQL)
def stream_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw words read as a stream by shard number, shaped and unpacked in each micro-batch."""
    path, run_dir = stored(spark, sf_dir, kind="raw"), fresh_dir(spark, "feed")

    def handle(batch: DataFrame, batch_id: int) -> None:
        packed, _ = shape_raw(batch, CONFIG)
        append_log(unpack_shards(packed), f"{run_dir}/samples", "run", batch_id)

    drain_store(spark, path, run_dir, handle, kind="raw", max_in_flight=RAW_IN_FLIGHT)
    schema = "shard_id bigint, pos_in_shard bigint, x array<bigint>, y bigint"
    return sample_sums(spark.read.schema(schema).parquet(f"{run_dir}/samples"))


@query("stream_paced", _log_sql(256, ", true AS ended, true AS in_order"))
def stream_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live run: a paced publisher, a consumer beside it that waits for each number, and an end by the end marker."""
    samples, span = to_publish(spark, sf_dir, STREAM_CONFIG)
    path, run_dir = create_store(spark, fresh_dir(spark, "store")), fresh_dir(spark, "feed")
    consumer = consume_store(
        spark, path, run_dir, shard_log_handler(f"{run_dir}/log", "run"), max_in_flight=IN_FLIGHT, gaps="wait", interval="200 milliseconds"
    )
    publisher = publish_paced(samples, path, f"{run_dir}/publisher", IN_FLIGHT, span=span)
    try:
        run_until_end(spark, path, consumer)
    finally:
        publisher.stop()
    log = spark.read.schema(FEED_LOG).parquet(f"{run_dir}/log")
    # Shards of a later micro-batch have higher numbers than all before it.
    spans = log.groupBy("batch_id").agg(F.min("shard_id").alias("low"), F.max("shard_id").alias("high"), F.count(F.lit(1)).alias("taken"))
    in_order = F.col("high") - F.col("low") + 1 == F.col("taken")
    return log.join(spans, "batch_id").select(
        *LOG_COLUMNS, F.lit(store_ended(spark, path)).alias("ended"), in_order.alias("in_order")
    )


@query(
    "stream_phases",
    f"WITH {DOC_SAMPLES} SELECT count(DISTINCT sample_id // 256) AS shards, count(*) AS samples, (count(*) * 8200)::BIGINT AS bytes, "
    "true AS timed, true AS within_wall FROM samples",
)
def stream_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run from its own log of phase times: every shard was timed, and phases do not exceed the wall time."""
    shards, run_dir = stored(spark, sf_dir, STREAM_CONFIG), fresh_dir(spark, "feed")
    work = shard_log_handler(f"{run_dir}/shards", "run")
    began = time.perf_counter()
    drain_store(spark, shards, run_dir, phase_log_handler(work, f"{run_dir}/log", "run"), max_in_flight=IN_FLIGHT)
    wall_ms = 1000 * (time.perf_counter() - began)
    log = spark.read.schema(PHASE_COLUMNS).parquet(f"{run_dir}/log").withColumns(
        {"run": F.lit("run"), "loss": F.lit(0.0), "correct": F.lit(0).cast("bigint")}
    )
    phases = F.col("wait_ms") + F.col("load_ms") + F.col("train_ms")
    return log.agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n").alias("samples"), F.sum("bytes").alias("bytes"),
        (F.min(F.least("load_ms", "train_ms")) > 0).alias("timed"), (F.sum(phases) <= wall_ms).alias("within_wall"),
    )


@query("stream_lookahead", _log_sql(128, f", s.shard_id // {LOOKAHEAD} AS wave"))
def stream_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publisher that may be at most ``LOOKAHEAD`` shards ahead of its consumer, as one streaming query.

    Its input are the events of shards that are ready and shards that are gone. What the state releases is published, read back, logged
    and deleted; that they are gone are new events. The micro-batch of a shard is its wave. While a wave is logged and its end goes
    through the state, the publisher writes the file of the shards that come next; nobody sees it before they are released.
    """
    samples, span = to_publish(spark, sf_dir, RAW_CONFIG)
    path, run_dir = create_store(spark, fresh_dir(spark, "store")), qualified(spark, fresh_dir(spark, "feed"))
    # One folder, from which the source deletes the files it has taken, so that looking for new ones costs the same all along.
    events, kinds = f"{run_dir}/events", "shard_id bigint, kind string"
    ready = samples.select("shard_id").distinct().select("shard_id", F.lit("ready").alias("kind"))
    ready.coalesce(1).write.parquet(events)
    last = spark.read.schema(kinds).parquet(events).agg(F.max("shard_id")).first()[0]
    log_path = f"{run_dir}/log"
    log_shards = shard_log_handler(log_path, "run", few=True)
    # What the publisher is writing for the next wave, if anything: its first and last number, and its file.
    ahead: dict[tuple[int, int], Future] = {}
    publisher = ThreadPoolExecutor(1)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Numbers in a row, at most LOOKAHEAD of them.
        released = [r["shard_id"] for r in batch.select("shard_id").collect()]
        if not released:
            return
        low, high = min(released), max(released)
        if not shards_between(spark, path, low, high):  # else this micro-batch has run before
            written = ahead.pop((low, high)).result() if (low, high) in ahead else None
            if written is None or written["file"].null_count:
                publish_few(span(low, high), path)
            else:
                publish_written(spark, written, path)
        ahead.clear()
        if high < last:
            following = (high + 1, min(high + LOOKAHEAD, last))
            ahead[following] = publisher.submit(lambda: write_few(span(*following), path))
        log_shards(read_store(spark, path, low, high), batch_id)
        gone = pa.array(range(low, high + 1), pa.int64())
        put_rows(pa.table({"shard_id": gone, "kind": pa.array(["retired"] * len(gone))}), f"{events}/{batch_id}.parquet")

    said = spark.readStream.schema(kinds).option("cleanSource", "delete").parquet(events).withColumn("stream", F.lit(0).cast("bigint"))
    # The one stream is one group, so its state needs one partition.
    with shuffles_of(spark, 1):
        query_ = run_stream(hold_back(said, "stream", LOOKAHEAD), handle, f"{run_dir}/checkpoint", "0 seconds")
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
        publisher.shutdown()
    sweep_store(spark, path)
    return spark.read.schema(FEED_LOG).parquet(log_path).select(*LOG_COLUMNS, F.col("batch_id").alias("wave"))


@query(
    "live_backlog",
    f"WITH {HELD} SELECT stream, sum(delta)::BIGINT AS items, sum(bytes)::BIGINT AS bytes_held, max(items)::BIGINT AS peak_items, "
    "max(bytes_held)::BIGINT AS peak_bytes FROM held GROUP BY 1",
)
def live_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog and its peaks kept while publish and retire events come in, out of order within a slice of time."""
    path, run_dir = fresh_dir(spark, "changes"), fresh_dir(spark, "feed")
    changes = held(spark, sf_dir).select("stream", "shard_id", "ts_us", "delta", "bytes")
    changes.write.parquet(path)
    schema = "stream bigint, shard_id bigint, ts_us bigint, delta bigint, bytes bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", CHANGE_FILES).parquet(path)
    # Each micro-batch is a task a state partition, so their number goes by the cores and not by the size of the tables.
    most = STATE_PARTS_A_CORE * spark.sparkContext.defaultParallelism
    with shuffles_of(spark, min(int(spark.conf.get("spark.sql.shuffle.partitions")), most)):
        query_, newest = keep_metrics(bounded.live_backlog(stream, "stream", ALL_TIME), run_dir, ["stream"])
    query_.awaitTermination()
    return newest().select("stream", "items", "bytes_held", "peak_items", "peak_bytes")


@query("stream_train", TRAINED)
def stream_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training fed by the stream, one shard per micro-batch: the shard log."""
    shards = stored(spark, sf_dir, STREAM_CONFIG)
    run_dir = fresh_dir(spark, "feed")
    drain_store(spark, shards, run_dir, training_handler(spark, run_dir, "run", STREAM_CONFIG), max_in_flight=1)
    schema = "shard_id bigint, n bigint, bytes bigint, loss double, correct bigint, acc double, batch_id bigint"
    log = spark.read.schema(schema).parquet(f"{run_dir}/log")
    return log.select("shard_id", "n", "bytes", r6(F.col("loss")).alias("loss"), "correct", r6(F.col("acc")).alias("acc"))


@query(
    "stream_metrics",
    f"WITH {PHASE_LOG} SELECT run, phase, count(*) AS n, round(sum(ms), 6) AS sum_ms, "
    "round(sum(ms) / count(*), 6) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM phase_log GROUP BY 1, 2",
)
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running metrics per run and phase over the whole event stream, as of its end."""
    schema = inputs.table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    metrics = phase_metrics(phase_log_of(events), ["run", "phase"])
    query_, newest = keep_metrics(metrics, fresh_dir(spark, "metrics"), ["run", "phase"])
    query_.awaitTermination()
    return newest().select(
        "run", "phase", "n", r6(F.col("sum_ms")).alias("sum_ms"), r6(F.col("mean_ms")).alias("mean_ms"),
        "min_ms", "max_ms",
    )

"""Consuming published shards as a stream: ordered, bounded, restartable, and retired after commit."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from millrace.config import WORD_BYTES, FeedConfig
from millrace.files import qualified
from millrace.operators.metrics import weighted_mean
from millrace.operators.model import Weights, fits_one_job, log_shard, log_step, state_after, train_shard, train_step, zero_state
from millrace.schemas import MODEL_STATE
from millrace.session import plain_checkpoints
from millrace.sinks.compact import compact_log
from millrace.sinks.log import append_log, append_rows, latest, read_log
from millrace.sinks.publish import retire_consumed
from millrace.sinks.store import end_store, publish_few, store_ended
from millrace.sources.store import Store, retire_taken, shards_between, stream_store
from millrace.sources.typed import read_shards, stream_shards

Handler = Callable[[DataFrame, int], None]


def run_stream(
    stream: DataFrame,
    handler: Handler,
    checkpoint: str,
    interval: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Start ``handler`` on every micro-batch.

    Without ``interval`` the query drains what is there and ends; with it, it is paced and runs on.
    The checkpoint holds what has been taken, so a restart goes on with the micro-batch that failed.
    """
    writer = (
        stream.writeStream.foreachBatch(handler)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
    )
    paced = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    with plain_checkpoints(stream.sparkSession, qualified(stream.sparkSession, checkpoint)):
        return paced.start()


def in_one_task(batch: DataFrame) -> bool:
    """Whether a micro-batch has one partition at most."""
    return batch._jdf.queryExecution().toRdd().getNumPartitions() <= 1


def gathered(batch: DataFrame) -> DataFrame:
    """A micro-batch of one partition as one that Spark knows to be whole, so that grouping its rows needs no shuffle, whose
    partitions are set for the whole run. Others are passed on as they are."""
    return batch.coalesce(1) if in_one_task(batch) else batch


def shard_log_handler(log_path: str, run_id: str, few: bool = False) -> Callable[[DataFrame, int], pa.Table | None]:
    """Log one row per shard: samples, bytes, a content sum, and its place in the order of consumption.

    The rows of a micro-batch of one partition come to the driver, which logs them without a second job and returns them. ``few`` says
    that micro-batches are of a few shards, which one task may read whatever their partitions.
    """
    # Made once, for they are the same in each micro-batch.
    figures = [
        F.count(F.lit(1)).alias("n"),
        F.sum((F.size("x").cast("bigint") + 1) * WORD_BYTES).alias("bytes"),
        F.sum(F.aggregate("x", F.lit(0).cast("bigint"), lambda s, t: s + t)).alias("token_sum"),
        F.sum("y").alias("n_pos"),
    ]

    def handle(batch: DataFrame, batch_id: int) -> pa.Table | None:
        if not few and not in_one_task(batch):
            append_log(batch.groupBy("shard_id").agg(*figures), log_path, run_id, batch_id)
            return None
        rows = batch.coalesce(1).groupBy("shard_id").agg(*figures).toArrow()
        append_rows(batch.sparkSession, rows, log_path, run_id, batch_id)
        return rows

    return handle


def in_number_order(
    spark: SparkSession, shard_path: str, run_dir: str, handler: Handler, retire: bool = False
) -> Handler:
    """``handler`` on the lowest shard numbers that are there and not yet taken, as many as a micro-batch brings.

    The file source hands out shards by the time of their files. What it hands out says here only how many may be
    taken; which ones follows from the numbers alone. They are written down, in one file, before they are handled, so a
    micro-batch that runs again takes the same ones. ``retire`` deletes shards of earlier micro-batches once they have
    been both taken and handed out.
    """
    taken, handed = f"{run_dir}/taken", f"{run_dir}/handed"
    kept = "shard_id bigint, run_id string, batch_id bigint"
    for path in (taken, handed):
        append_log(spark.createDataFrame([], "shard_id bigint"), path, "order", -1)

    def numbers(path: str) -> DataFrame:
        return spark.read.schema(kept).parquet(path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_log(batch.select("shard_id").distinct(), handed, "order", batch_id)
        earlier = F.col("batch_id") < batch_id
        before = numbers(taken).where(earlier).select("shard_id")
        if numbers(taken).where(F.col("batch_id") == batch_id).isEmpty():
            allowed = numbers(handed).where(F.col("batch_id") == batch_id).count()
            there = read_shards(spark, shard_path).select("shard_id").distinct()
            free = there.join(before, "shard_id", "left_anti")
            append_log(free.orderBy("shard_id").limit(allowed).coalesce(1), taken, "order", batch_id)
        mine = numbers(taken).where(F.col("batch_id") == batch_id).select("shard_id")
        low, high, n = mine.agg(F.min("shard_id"), F.max("shard_id"), F.count(F.lit(1))).first()
        if n:
            rows = read_shards(spark, shard_path).where(F.col("shard_id").between(low, high))
            handler(rows if high - low + 1 == n else rows.join(mine, "shard_id", "left_semi"), batch_id)
        if retire:
            both = numbers(handed).where(earlier).select("shard_id").join(before, "shard_id", "left_semi")
            retire_consumed(spark, shard_path, both)

    return handle


def drain_shards(
    spark: SparkSession,
    shard_path: str,
    run_dir: str,
    handler: Handler,
    max_in_flight: int | None = None,
    retire: bool = False,
) -> StreamingQuery:
    """Take all published shards, lowest number first, at most ``max_in_flight`` per micro-batch, and stop at the end."""
    stream = stream_shards(spark, shard_path, max_in_flight)
    ordered = in_number_order(spark, shard_path, run_dir, handler, retire)
    query = run_stream(stream, ordered, f"{run_dir}/checkpoint")
    query.awaitTermination()
    return query


def consume_store(
    spark: SparkSession,
    path: str,
    run_dir: str,
    handler: Handler,
    kind: str = "typed",
    max_in_flight: int | None = None,
    gaps: str = "skip",
    retire: bool = False,
    interval: str = "0 seconds",
) -> StreamingQuery:
    """Start ``handler`` on the shards of a store, lowest number first, at most ``max_in_flight`` per micro-batch.

    The checkpoint holds the next shard number, so a restart goes on with the micro-batch that failed. ``interval`` paces the run.
    """
    stream = stream_store(spark, path, kind, max_in_flight, gaps, retire)
    return run_stream(stream, handler, f"{run_dir}/checkpoint", interval)


def drain_store(spark: SparkSession, path: str, run_dir: str, handler: Handler, **options) -> StreamingQuery:
    """``consume_store`` until all shards that are there have been taken."""
    query = consume_store(spark, path, run_dir, handler, **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def run_until_end(spark: SparkSession, path: str, query: StreamingQuery, look_s: float = 0.5) -> StreamingQuery:
    """Let a query over a store run until the end marker is there and nothing is left to take, then stop it.

    A query that fails raises here.
    """
    while not store_ended(spark, path):
        if query.awaitTermination(look_s):
            return query
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def publish_paced(
    samples: DataFrame,
    path: str,
    run_dir: str,
    per_tick: int = 1,
    interval: str = "500 milliseconds",
    kind: str = "typed",
    span: Callable[[int, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Publish the next ``per_tick`` shard numbers of a stored table every ``interval``, then the end marker.

    The numbers come from a rate source, so a restart goes on where the checkpoint stands, and a tick that runs again
    publishes only what is not there yet. ``span``, if given, reads the shards from one number to another, both included, from just the
    files that hold them; without it a tick looks at all of ``samples``. The query goes on ticking without work; stop it once the store has ended.
    """
    spark = samples.sparkSession
    highest = samples.agg(F.max("shard_id")).first()[0]
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_tick).option("numPartitions", 1).load()

    def tick(batch: DataFrame, batch_id: int) -> None:
        if store_ended(spark, path):
            return
        low, high = batch.agg(F.min("value"), F.max("value")).first()
        mine = span(low, high) if span else samples.where(F.col("shard_id").between(low, high))
        # per_tick numbers at most
        known = shards_between(spark, path, low, high)
        publish_few(mine.where(~F.col("shard_id").isin(known)) if known else mine, path, kind)
        if highest is None or high >= highest:
            end_store(spark, path)

    return run_stream(ticks, tick, f"{run_dir}/checkpoint", interval)


PHASE_COLUMNS = "shard_id bigint, n bigint, bytes bigint, wait_ms double, load_ms double, pin_ms double, h2d_ms double, train_ms double, finish_us bigint"


def phase_log_handler(work: Handler, log_path: str, run_id: str) -> Handler:
    """``work`` on every micro-batch, and one log row per shard that says where the time went.

    Waiting is from the end of one micro-batch, or the start of the run, to the handing over of the next, and is written down at its
    lowest shard; loading is the reading of its rows, training the work on them, both shared out by bytes. There is
    no device, so the times of copying to one are 0. The log has the columns of ``operators.metrics`` and ``timeline``.
    """
    idle_since = time.perf_counter()

    def handle(batch: DataFrame, batch_id: int) -> None:
        nonlocal idle_since
        begin = time.perf_counter()
        held = gathered(batch).persist()
        words = (F.size("x").cast("bigint") + 1) * WORD_BYTES
        # As many rows as shards in flight.
        found = held.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.sum(words).alias("bytes")).collect()
        sizes = sorted(found, key=lambda r: r["shard_id"])
        loaded = time.perf_counter()
        work(held, batch_id)
        held.unpersist()
        done = time.perf_counter()
        total = sum(r["bytes"] for r in sizes) or 1
        rows = [
            (
                r["shard_id"], r["n"], r["bytes"], 1000 * (begin - idle_since) if k == 0 else 0.0, 1000 * (loaded - begin) * r["bytes"] / total,
                0.0, 0.0, 1000 * (done - loaded) * r["bytes"] / total, time.time_ns() // 1000,
            )
            for k, r in enumerate(sizes)
        ]
        schema = to_arrow_schema(T.StructType.fromDDL(PHASE_COLUMNS))
        table = pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)
        append_rows(batch.sparkSession, table, log_path, run_id, batch_id)
        idle_since = time.perf_counter()

    return handle


def sweep(spark: SparkSession, shard_path: str, log: DataFrame) -> int:
    """Delete the shards that a finished query has logged.

    A shard is deleted only in a later micro-batch, so the last ones stay behind.
    """
    return retire_consumed(spark, shard_path, log.select("shard_id"))


def sweep_store(spark: SparkSession, path: str) -> int:
    """Delete the files of a store all of whose shards a finished run has taken; its last micro-batch leaves some behind."""
    store = Store(qualified(spark, path))
    snapshot = store.newest()
    highest = max((p["high"] for p in snapshot["index"]), default=-1)
    return retire_taken(store, {"next": highest + 1, "version": snapshot["version"]})


def training_handler(
    spark: SparkSession,
    run_dir: str,
    run_id: str,
    config: FeedConfig,
    minibatch: int | None = None,
    seed: int = 0,
) -> Handler:
    """Train on the shards of a micro-batch and log each one.

    Without ``minibatch`` a micro-batch is one optimizer step over all its shards: one job for the summed gradient, and the driver
    writes the log rows and the state. A micro-batch starts from what the one before it left, so one that runs again repeats
    the same step and overwrites the same file. With ``minibatch`` steps go through tables, shard after shard.
    """
    # The state after the last micro-batch that was logged; any other is read from the log.
    left: dict[int, Weights] = {}

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = f"{run_dir}/log"
        state = left.pop(batch_id - 1, None) or (state_after(spark, log, run_id, batch_id - 1, config) if batch_id else Weights(config))
        left.clear()
        metrics = train_step(batch, state, config)
        log_step(spark, metrics, state, log, run_id, batch_id)
        if metrics:
            left[batch_id] = state

    return handle if minibatch is None and fits_one_job(config) else _training_by_tables(spark, run_dir, run_id, config, minibatch, seed)


def _training_by_tables(spark: SparkSession, run_dir: str, run_id: str, config: FeedConfig, minibatch: int | None, seed: int) -> Handler:
    """State is kept per shard place, and a micro-batch starts from what the one before it left."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        # At most max_in_flight numbers.
        ids = sorted(r["shard_id"] for r in held.select("shard_id").distinct().collect())
        state, step = zero_state(spark), 0
        marker = f"{run_dir}/done/batch_id={batch_id - 1}"
        if batch_id > 0:
            before = spark.read.parquet(marker).first()
            step = before["step"]
            if before["path"]:
                state = spark.read.schema(MODEL_STATE).parquet(before["path"])
        path = before["path"] if batch_id > 0 else ""
        for shard_id in ids:
            root = f"{run_dir}/state/batch={batch_id}/shard={shard_id}"
            shard = held.where(F.col("shard_id") == shard_id)
            first = step
            state, step, m = train_shard(shard, state, step, config, root, minibatch, seed)
            if step > first:
                path = f"{root}/part={step - first - 1}"
            log_shard(spark, m, shard_id, f"{run_dir}/log/shard={shard_id}", run_id, batch_id)
        done = spark.createDataFrame([(step, path)], "step int, path string")
        done.write.mode("overwrite").parquet(f"{run_dir}/done/batch_id={batch_id}")
        held.unpersist()

    return handle


def phase_metrics(stream: DataFrame, by: list[str]) -> DataFrame:
    """Running n, sum, mean, min and max of ``ms`` per group of a stream of phase rows."""
    return stream.groupBy(*by).agg(
        F.count("ms").alias("n"),
        F.sum("ms").alias("sum_ms"),
        weighted_mean(F.col("ms"), F.lit(1)).alias("mean_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )


def keep_metrics(
    metrics: DataFrame, run_dir: str, by: list[str], run_id: str = "run", interval: str | None = None, compact_every: int = 16
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Keep running metrics in a log of updates: (query, function that gives the newest per group).

    Every ``compact_every`` micro-batches the log is merged down to the newest row of each group, so it grows with the groups alone.
    """
    spark = metrics.sparkSession
    path = f"{run_dir}/metrics"

    logged = T.StructType(
        [
            *metrics.schema.fields,
            T.StructField("run_id", T.StringType()),
            T.StructField("batch_id", T.LongType()),
        ]
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_log(batch, path, run_id, batch_id)
        if (batch_id + 1) % compact_every == 0:
            compact_log(batch.sparkSession, path, logged, by)

    query = run_stream(metrics, handle, f"{run_dir}/checkpoint", interval, mode="update")
    return query, lambda: latest(read_log(spark, path, logged), by, run_id)

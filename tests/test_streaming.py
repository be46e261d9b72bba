from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.operators import model as M
from millrace.session import fresh_dir, local_path
from millrace.sinks.publish import publish_shards
from millrace.sources.synth import synth_uniform
from millrace.sources.typed import in_shard_order
from millrace.streaming import feed as S

TINY = FeedConfig(batch_size=8, seq_len=5, vocab=50)
LOG = "shard_id bigint, n bigint, bytes bigint, token_sum bigint, n_pos bigint, run_id string, batch_id bigint"


@pytest.fixture
def shards(spark):
    path = fresh_dir(spark, "shards")
    publish_shards(synth_uniform(spark, 6, 8, TINY), path)
    return path


def drained(spark, shards, run, in_flight):
    S.drain_shards(spark, shards, run, S.shard_log_handler(f"{run}/log", "r"), in_flight)
    return spark.read.schema(LOG).parquet(f"{run}/log")


def test_bounded_and_flushed_give_the_same_log(spark, shards):
    logs = {}
    for in_flight in (1, 2, None):
        log = drained(spark, shards, fresh_dir(spark, "run"), in_flight)
        logs[in_flight] = sorted(tuple(r)[:5] for r in log.collect())
        sizes = [r["count"] for r in log.groupBy("batch_id").count().collect()]
        assert max(sizes) <= (in_flight or 6) and sum(sizes) == 6
        assert len(sizes) == (1 if in_flight is None else 6 // in_flight)
    assert logs[1] == logs[2] == logs[None]


def test_micro_batch_is_in_shard_order(spark):
    path, run = fresh_dir(spark, "shards"), fresh_dir(spark, "run")
    for shard in (10, 2, 7):  # published out of order
        publish_shards(synth_uniform(spark, 11, 8, TINY).where(F.col("shard_id") == shard), path, "append")
    seen = []

    def handle(batch, batch_id):
        seen.extend((r["shard_id"], r["pos_in_shard"]) for r in in_shard_order(batch).collect())

    S.drain_shards(spark, path, run, handle)
    assert seen == [(s, p) for s in (2, 7, 10) for p in range(8)]


def test_micro_batches_are_in_number_order(spark):
    """Published 10, 2, 7, 5 in time; taken by number, also where a micro-batch fails and where deletions go along."""
    for in_flight, retire in ((1, False), (1, True), (3, True)):
        path, run = fresh_dir(spark, "shards"), fresh_dir(spark, "run")
        for shard in (10, 2, 7, 5):
            publish_shards(synth_uniform(spark, 11, 8, TINY).where(F.col("shard_id") == shard), path, "append")
        seen, failed = [], []

        def handle(batch, batch_id):
            if batch_id == 1 and not failed:
                failed.append(batch_id)
                raise RuntimeError("lost")
            held = in_shard_order(batch).collect()
            assert len(held) % 8 == 0
            seen.extend(r["shard_id"] for r in held[::8])

        with pytest.raises(Exception, match="lost"):
            S.drain_shards(spark, path, run, handle, in_flight, retire)
        S.drain_shards(spark, path, run, handle, in_flight, retire)
        assert seen == [2, 5, 7, 10]


def test_restart_neither_loses_nor_doubles(spark, shards):
    run = fresh_dir(spark, "run")
    log = S.shard_log_handler(f"{run}/log", "r")
    attempts = []

    def fails_once(batch, batch_id):
        attempts.append(batch_id)
        log(batch, batch_id)
        if batch_id == 2 and attempts.count(2) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        S.drain_shards(spark, shards, run, fails_once, 1)
    S.drain_shards(spark, shards, run, fails_once, 1)
    assert attempts == [0, 1, 2, 2, 3, 4, 5]
    got = spark.read.schema(LOG).parquet(f"{run}/log")
    assert sorted(r["shard_id"] for r in got.collect()) == list(range(6))


def test_shards_that_come_later_are_taken_by_the_next_run(spark, shards):
    run = fresh_dir(spark, "run")
    assert drained(spark, shards, run, 2).count() == 6
    more = synth_uniform(spark, 8, 8, TINY).where("shard_id >= 6")
    publish_shards(more, shards, "append")
    log = drained(spark, shards, run, 2)
    assert sorted(r["shard_id"] for r in log.collect()) == list(range(8))


def test_nothing_is_left_after_the_sweep(spark, shards):
    run = fresh_dir(spark, "run")
    S.drain_shards(spark, shards, run, S.shard_log_handler(f"{run}/log", "r"), 2, retire=True)
    log = spark.read.schema(LOG).parquet(f"{run}/log")
    S.sweep(spark, shards, log)
    left = [f for _, _, fs in os.walk(local_path(shards)) for f in fs if f.endswith(".parquet")]
    assert log.count() == 6 and left == []


def by_shard(log):
    return {r["shard_id"]: (r["n"], round(r["loss"], 9), r["correct"]) for r in log.collect()}


def train(spark, shards, run, handler=None):
    S.drain_shards(spark, shards, run, handler or S.training_handler(spark, run, "r", TINY), 1)
    schema = "shard_id bigint, n bigint, loss double, correct bigint, batch_id bigint"
    return spark.read.schema(schema).parquet(f"{run}/log")


def test_training_from_the_stream_is_training_from_the_table(spark):
    path = fresh_dir(spark, "shards")
    samples = synth_uniform(spark, 3, 8, TINY)
    for shard in (2, 0, 1):  # trained by number, whatever the order of publishing
        publish_shards(samples.where(F.col("shard_id") == shard), path, "append")
    want, _ = M.train_over_shards(samples, TINY, fresh_dir(spark, "t"))
    run = fresh_dir(spark, "run")
    handler = S.training_handler(spark, run, "r", TINY)
    calls = []

    def fails_once(batch, batch_id):
        handler(batch, batch_id)
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        train(spark, path, run, fails_once)
    assert by_shard(train(spark, path, run, fails_once)) == by_shard(want)


@pytest.mark.parametrize("compact_every", [2, 16])
def test_running_metrics(spark, compact_every):
    path = fresh_dir(spark, "log")
    schema = "run int, phase string, ms double"
    rows = [(i % 3, "wait" if i % 2 else "load", float(i)) for i in range(30)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query, newest = S.keep_metrics(S.phase_metrics(stream, ["run", "phase"]), fresh_dir(spark, "m"), ["run", "phase"], compact_every=compact_every)
    query.awaitTermination()
    got = {(r["run"], r["phase"]): (r["n"], r["sum_ms"], r["min_ms"], r["max_ms"]) for r in newest().collect()}
    want = {}
    for run, phase, ms in rows:
        n, s, lo, hi = want.get((run, phase), (0, 0.0, ms, ms))
        want[(run, phase)] = (n + 1, s + ms, min(lo, ms), max(hi, ms))
    assert got == want


def test_a_micro_batch_of_one_partition_is_not_shuffled(spark):
    """Shuffle partitions are set for the whole run, so a shuffle would cost each small micro-batch as many tasks."""
    rows = synth_uniform(spark, 3, 8, TINY)

    def exchanges(df):
        return df.groupBy("shard_id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange")

    one = rows.coalesce(1)
    assert exchanges(S.gathered(one.localCheckpoint())) == 0
    several = rows.repartition(3)
    assert exchanges(S.gathered(several)) > 0 and S.gathered(several).rdd.getNumPartitions() == 3


def test_phases_are_logged_by_shard(spark, shards):
    run = fresh_dir(spark, "run")
    S.drain_shards(spark, shards, run, S.phase_log_handler(S.shard_log_handler(f"{run}/work", "r"), f"{run}/log", "r"), 4)
    log = spark.read.schema(S.PHASE_COLUMNS).parquet(f"{run}/log").orderBy("shard_id").collect()
    assert [(r.shard_id, r.n, r.bytes) for r in log] == [(s, 8, 8 * 8 * 6) for s in range(6)]
    assert all(r.load_ms > 0 and r.train_ms > 0 and r.finish_us for r in log)
    assert spark.read.schema(LOG).parquet(f"{run}/work").count() == 6


def test_rows_of_a_first_run_by_a_job_are_replaced(spark):
    """A micro-batch that runs again may be logged by the driver where a job has logged it before."""
    path = fresh_dir(spark, "log")
    rows = spark.createDataFrame([(1, 2), (3, 4)], "shard_id bigint, n bigint")
    S.append_log(rows, path, "r", 0)
    S.append_rows(spark, rows.toArrow(), path, "r", 0)
    assert sorted((r.shard_id, r.n) for r in spark.read.schema("shard_id bigint, n bigint").parquet(path).collect()) == [(1, 2), (3, 4)]


def test_the_log_of_a_micro_batch_is_written_from_one_reading(spark):
    """Rows of one partition come back with the log, so what else is said of its shards needs no second reading."""
    samples, run = synth_uniform(spark, 3, 8, TINY), fresh_dir(spark, "run")
    log = S.shard_log_handler(f"{run}/log", "r")
    rows = log(samples.coalesce(1), 0)
    assert sorted(rows["shard_id"].to_pylist()) == [0, 1, 2] and rows["n"].to_pylist() == [8, 8, 8]
    assert log(samples.repartition(3), 1) is None
    assert S.shard_log_handler(f"{run}/log", "r", few=True)(samples.repartition(3), 2).num_rows == 3
    got = {}
    for r in spark.read.schema(LOG).parquet(f"{run}/log").collect():
        got.setdefault(r.batch_id, set()).add(tuple(r)[:5])
    assert got[0] == got[1] == got[2] and len(got[0]) == 3


def test_checkpoints_on_a_local_disk_are_written_the_plain_way(spark, monkeypatch):
    from millrace import session

    name, seen = session.CHECKPOINTS, []
    with session.plain_checkpoints(spark, "file:/tmp/x"):
        seen.append(spark.conf.get(name, None))
    with session.plain_checkpoints(spark, "hdfs://far/x"):
        seen.append(spark.conf.get(name, None))
    with session._set(spark, name, "named"), session.plain_checkpoints(spark, "file:/tmp/x"):
        seen.append(spark.conf.get(name, None))
    assert seen == [session.PLAIN_CHECKPOINTS, None, "named"] and spark.conf.get(name, None) is None

from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.operators.batching import unpack_shards
from millrace.session import drop_staged, fresh_dir, local_path, stage
from millrace.sinks import publish as P
from millrace.sources import raw as R
from millrace.sources.synth import fill_word, paced_source, synth_fill, synth_uniform
from millrace.sources.typed import read_shards

TINY = FeedConfig(batch_size=8, seq_len=5, vocab=50)


def rows(df):
    return {(r["shard_id"], r["pos_in_shard"], tuple(r["x"]), r["y"]) for r in df.collect()}


def touch(folder, *names):
    for name in names:
        open(os.path.join(folder, name), "wb").close()


def test_raw_layout_and_round_trip(spark, folder):
    samples = synth_uniform(spark, 3, 8, TINY)
    log = {r["shard_id"]: r["bytes"] for r in P.publish_raw_shards(samples, folder).collect()}
    assert log == {i: 8 * 48 for i in range(3)}
    assert sorted(os.listdir(folder)) == ["shard_0.pt", "shard_1.pt", "shard_2.pt"]
    words = np.fromfile(os.path.join(folder, "shard_1.pt"), dtype="<i8")
    mine = samples.where("shard_id = 1").orderBy("pos_in_shard").collect()
    assert words.tolist() == [t for r in mine for t in r["x"]] + [r["y"] for r in mine]
    packed, rejected = R.shape_raw(R.read_raw_shards(spark, folder), TINY)
    assert rows(unpack_shards(packed)) == rows(samples) and rejected.count() == 0


def test_words_of_any_sign_are_clamped(spark, folder):
    words = np.array([-1, -(2**63), 2**62, 0, 10000, -3], dtype="<i8")
    words.tofile(os.path.join(folder, "shard_7.pt"))
    raw = R.read_raw_shards(spark, folder)
    assert raw.first()["words"] == words.tolist() and raw.first()["length"] == 48
    packed, _ = R.shape_raw(raw, TINY)
    row = packed.first()
    assert row["x"] == [[w % 50 for w in words.tolist()[:5]]] and row["y"] == [1]


def test_short_shard_is_rejected_and_tmp_is_not_seen(spark, folder):
    np.arange(47, dtype="<i8").tofile(os.path.join(folder, "shard_2.pt"))
    np.arange(48, dtype="<i8").tofile(os.path.join(folder, "shard_10.pt"))
    np.arange(48, dtype="<i8").tofile(os.path.join(folder, "shard_3.pt.tmp"))
    touch(folder, "DONE", "shard_4.pt")
    packed, rejected = R.shape_raw(R.read_raw_shards(spark, folder), TINY)
    assert [(r["shard_id"], len(r["x"]), len(r["y"])) for r in packed.collect()] == [(10, 8, 8)]
    assert [(r["shard_id"], r["reason"]) for r in rejected.collect()] == [(2, "length")]
    assert [(r["shard_id"], r["reason"]) for r in R.empty_shards(spark, folder).collect()] == [(4, "empty")]


def test_fill(spark):
    words = spark.createDataFrame([(200,), (127,), (456,), (0,)], "b bigint").select(fill_word(F.col("b")).alias("w"))
    assert [r["w"] for r in words.collect()] == [-3978709506094217016, 9187201950435737471, -3978709506094217016, 0]
    batch = synth_fill(spark, 3, 2, 3).orderBy("shard_id").collect()[2]
    assert batch["words"] == [int.from_bytes(b"\2" * 8, "little")] * 8 and batch["length"] == 64
    packed, _ = R.shape_raw(synth_fill(spark, 201, 2, 3), FeedConfig(batch_size=2, seq_len=3))
    last = packed.where("shard_id = 200").first()
    assert last["x"] == [[2984] * 3] * 2 and last["y"] == [0, 0]


def test_typed_shards_are_one_file_each_and_prune(spark):
    path = fresh_dir(spark, "typed")
    samples = synth_uniform(spark, 5, 8, TINY)
    P.publish_shards(samples.repartition(13), path)
    local = local_path(path)
    folders = sorted(d for d in os.listdir(local) if d.startswith("shard_id="))
    assert len(folders) == 5 and "_temporary" not in os.listdir(local) and "_SUCCESS" in os.listdir(local)
    assert all(len([f for f in os.listdir(os.path.join(local, d)) if f.endswith(".parquet")]) == 1 for d in folders)
    assert rows(read_shards(spark, path)) == rows(samples)
    one = read_shards(spark, path).where("shard_id = 3")
    assert "PartitionFilters: [isnotnull(shard_id" in one._jdf.queryExecution().toString()
    assert len(one.inputFiles()) == 5 and rows(one) == rows(samples.where("shard_id = 3"))


def test_purge(spark, folder):
    touch(folder, "shard_0.pt", "shard_1.pt.tmp", "DONE", "shard_2.bin", "keep.txt")
    assert P.purge_leftovers(spark, folder) == 3
    assert sorted(os.listdir(folder)) == ["keep.txt", "shard_2.bin"]
    assert P.purge_leftovers(spark, folder, strict=False) == 1
    assert os.listdir(folder) == ["keep.txt"]


def test_end_marker_counts_only_when_no_shard_is_left(spark, folder):
    touch(folder, "shard_0.pt")
    assert not P.stream_ended(spark, folder)
    P.end_of_stream(folder)
    assert not P.stream_ended(spark, folder) and "DONE" in os.listdir(folder)
    gone = spark.createDataFrame([(0,)], "shard_id bigint")
    assert P.retire_consumed(spark, folder, gone) == 1
    assert P.stream_ended(spark, folder) and os.listdir(folder) == []


def test_retire_takes_only_what_was_consumed(spark, folder):
    touch(folder, "shard_1.pt", "shard_10.pt", "shard_2.pt.tmp")
    assert P.retire_consumed(spark, folder, spark.createDataFrame([(1,), (1,)], "shard_id bigint")) == 1
    assert sorted(os.listdir(folder)) == ["shard_10.pt", "shard_2.pt.tmp"]


def test_lookahead_bound_for_publishers(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "shard_id bigint")
    now = lambda pending, present, n: sorted(r["shard_id"] for r in P.publishable_now(ids(*pending), ids(*present), n).collect())
    assert now(range(6), [99], 0) == list(range(6))
    assert now(range(6), [99], 2) == [0, 1]
    assert now(range(2, 6), [0, 1], 2) == []
    assert now(range(2, 6), [1], 2) == [2]


def test_publishing_twice_gives_the_same_files(spark, folder):
    samples = synth_uniform(spark, 2, 8, TINY)
    P.publish_raw_shards(samples, folder).collect()
    P.publish_raw_shards(samples, folder).collect()
    packed, _ = R.shape_raw(R.read_raw_shards(spark, folder), TINY)
    assert rows(unpack_shards(packed)) == rows(samples)


def test_shard_at_the_cap_is_refused(spark, folder):
    samples = synth_uniform(spark, 1, 8, TINY)
    with pytest.raises(Exception, match="shard 0 has 384 bytes, allowed are 1 to 383"):
        P.publish_raw_shards(samples, folder, cap=384)
    assert P.publish_raw_shards(samples, folder, cap=385).first()["bytes"] == 384


def test_listing_shows_empty_files(spark, folder):
    touch(folder, "shard_12.pt", "DONE")
    files = R.list_files(spark, folder)
    assert {(r["name"], r["shard_id"], r["length"]) for r in files.collect()} == {("shard_12.pt", 12, 0), ("DONE", None, 0)}


def test_stage(spark):
    df = spark.range(5).withColumn("s", F.lit("a"))
    staged = stage(df)
    assert staged.schema["id"].dataType == df.schema["id"].dataType and staged.count() == 5
    assert "LocalTableScan" not in staged._jdf.queryExecution().toString() and "parquet" in staged._jdf.queryExecution().toString()


@pytest.mark.parametrize("fn", [R._decode, R._lister(True), P._raw_writer("x", 1), P._deleter])
def test_task_functions_need_no_package_on_the_worker(fn, folder):
    load = "import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(fn), cwd=folder, env=env, check=True)


def test_drop_staged(spark):
    drop_staged()
    path = stage(spark.range(3)).inputFiles()[0]
    assert os.path.exists(local_path(path)) and drop_staged() == 1 and not os.path.exists(local_path(path))


def test_paced_source(spark):
    run = fresh_dir(spark, "paced")
    stream = paced_source(spark, TINY, seed=1)
    sizes = {}

    def handle(batch, batch_id):
        got = batch.collect()
        if got:
            sizes[batch_id] = (len(got), {r["shard_id"] for r in got})

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", run).trigger(processingTime="300 milliseconds").start()
    import time

    deadline = time.time() + 30
    while len(sizes) < 3 and time.time() < deadline:
        time.sleep(0.2)
    query.stop()
    assert len(sizes) >= 3
    assert [sizes[b] for b in sorted(sizes)] == [(8, {i}) for i in range(len(sizes))]

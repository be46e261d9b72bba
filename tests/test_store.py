"""Indexed shard files and the stream by shard number: gaps, late and retired shards, restarts, aborted and rival publications."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.files import exists, publish_text, qualified
from millrace.operators.batching import unpack_shards
from millrace.session import fresh_dir, local_path
from millrace.sinks import store as sink
from millrace.sources import store as source
from millrace.sources.raw import shape_raw
from millrace.sources.synth import synth_uniform
from millrace.streaming import feed as S

TINY = FeedConfig(batch_size=8, seq_len=5, vocab=50)


def samples(spark, shards):
    return synth_uniform(spark, max(shards) + 1, 8, TINY).where(F.col("shard_id").isin(list(shards)))


def store(spark, *publications, kind="typed", **options):
    path = sink.create_store(spark, fresh_dir(spark, "store"), kind)
    for shards in publications:
        sink.publish(samples(spark, shards), path, kind, **options)
    return path


def rows(df):
    return sorted((r.shard_id, r.pos_in_shard, tuple(r.x), r.y) for r in df.collect())


def data_files(path):
    return sorted(f for d, _, names in os.walk(local_path(path) + "/data") for f in names if f.endswith((".parquet", ".words")))


def taken(spark, path, run, fail_at=None, **options):
    """Shards of each micro-batch, in order."""
    seen, failed = [], []

    def handle(batch, batch_id):
        if batch_id == fail_at and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        held = batch.select("shard_id", *(["pos_in_shard"] if "x" in batch.columns else [])).collect()
        numbers = sorted({r.shard_id for r in held})
        assert "x" not in batch.columns or len(held) == 8 * len(numbers)
        if numbers:  # the first micro-batch of an empty store is empty
            seen.append(numbers)

    if fail_at is not None:
        with pytest.raises(Exception, match="lost"):
            S.drain_store(spark, path, run, handle, **options)
    S.drain_store(spark, path, run, handle, **options)
    return seen


def test_many_shards_in_a_file_and_a_shard_in_one(spark):
    path = store(spark, range(40), file_bytes=16 * 8 * 48)
    log = source.index_of(spark, path)
    assert [(r.shard_id, r.n, r.bytes) for r in log.orderBy("shard_id").collect()] == [(s, 8, 8 * 48) for s in range(40)]
    assert len(data_files(path)) == 3 and log.select("file").distinct().count() == 3
    assert rows(source.read_store(spark, path)) == rows(samples(spark, range(40)))
    one = source.read_store(spark, path, 5, 5)
    assert rows(one) == rows(samples(spark, [5])) and len(one.inputFiles()) == 1
    assert source.read_store(spark, path, 90, 99).count() == 0


def test_raw_words_come_back_as_samples(spark):
    path = store(spark, range(12), [15, 13], kind="raw", file_bytes=5 * 8 * 48)
    packed, rejected = shape_raw(source.read_raw_store(spark, path), TINY)
    assert rows(unpack_shards(packed)) == rows(samples(spark, [*range(12), 13, 15])) and rejected.count() == 0
    assert taken(spark, path, fresh_dir(spark, "run"), kind="raw", max_in_flight=8) == [list(range(8)), [8, 9, 10, 11, 13, 15]]


def test_sizes_are_refused_before_anything_is_written(spark):
    path = store(spark, kind="raw")
    with pytest.raises(ValueError, match="384 bytes"):
        sink.publish(samples(spark, range(3)), path, "raw", cap=384)
    assert data_files(path) == [] and source.index_of(spark, path).count() == 0
    with pytest.raises(ValueError, match="holds raw"):
        sink.publish(samples(spark, range(3)), path)
    assert sink.publish(samples(spark, range(3)).limit(0), path, "raw").count() == 0
    sink.end_store(spark, path)
    with pytest.raises(ValueError, match="ended"):
        sink.publish(samples(spark, range(3)), path, "raw")


def test_what_was_not_finished_is_not_seen(spark, monkeypatch):
    path = store(spark, [0, 1])
    monkeypatch.setattr(sink, "_next_snapshot", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sink.publish(samples(spark, [2, 3]), path)
    monkeypatch.undo()
    assert len(data_files(path)) == 2 and {r.shard_id for r in source.read_store(spark, path).collect()} == {0, 1}
    sink.publish(samples(spark, [2, 3]), path)
    assert rows(source.read_store(spark, path)) == rows(samples(spark, range(4)))


def test_of_two_publications_at_once_one_fails(spark):
    path = store(spark, [0])
    now = source.Store(path).newest()
    sink.publish(samples(spark, [1]), path)
    with pytest.raises(FileExistsError):
        sink._next_snapshot(spark, path, now, index=[])
    assert source.index_of(spark, path).count() == 2
    with pytest.raises(FileExistsError):
        sink.create_store(spark, path)


def test_index_files_are_merged(spark):
    path = store(spark, *[[k] for k in range(7)], merge_at=3)
    newest = source.Store(path).newest()
    assert newest["version"] == 7 and len(newest["index"]) <= 3
    log = {r.shard_id: r.version for r in source.index_of(spark, path).collect()}
    assert log == {k: k + 1 for k in range(7)}
    assert taken(spark, path, fresh_dir(spark, "run"), max_in_flight=3) == [[0, 1, 2], [3, 4, 5], [6]]


def test_lowest_numbers_first_whatever_the_order_of_publishing(spark):
    path = store(spark, [10], [2], [7], [5])
    for fail_at in (None, 0, 1):
        assert taken(spark, path, fresh_dir(spark, "run"), fail_at, max_in_flight=1) == [[2], [5], [7], [10]]
    assert taken(spark, path, fresh_dir(spark, "run"), max_in_flight=3) == [[2, 5, 7], [10]]
    assert taken(spark, path, fresh_dir(spark, "run")) == [[2, 5, 7, 10]]
    assert taken(spark, store(spark), fresh_dir(spark, "run")) == []


def test_a_restart_goes_on_where_it_was(spark):
    path, run = store(spark, range(5)), fresh_dir(spark, "run")
    assert taken(spark, path, run, max_in_flight=2) == [[0, 1], [2, 3], [4]]
    assert taken(spark, path, run, max_in_flight=2) == []
    sink.publish(samples(spark, [5, 6, 9]), path)
    assert taken(spark, path, run, 3, max_in_flight=2) == [[5, 6], [9]]
    sink.publish(samples(spark, [12, 7]), path)  # a lower number comes late
    sink.publish(samples(spark, [8, 11]), path)
    assert taken(spark, path, run, max_in_flight=2) == [[7], [8], [11, 12]]
    assert taken(spark, path, run, max_in_flight=2) == []


def test_waiting_for_gaps_until_the_end(spark):
    path, run = store(spark, [0, 1, 3]), fresh_dir(spark, "run")
    assert taken(spark, path, run, gaps="wait", max_in_flight=5) == [[0, 1]]
    sink.publish(samples(spark, [2]), path)
    assert taken(spark, path, run, gaps="wait", max_in_flight=5) == [[2, 3]]
    sink.publish(samples(spark, [6]), path)
    assert taken(spark, path, run, gaps="wait") == []
    sink.end_store(spark, path)
    assert taken(spark, path, run, gaps="wait") == [[6]]


def test_files_go_once_all_their_shards_are_taken(spark):
    path, run = store(spark, range(6), file_bytes=2 * 8 * 48), fresh_dir(spark, "run")
    assert len(data_files(path)) == 3
    left = []

    def handle(batch, batch_id):
        batch.count()
        left.append(len(data_files(path)))

    S.drain_store(spark, path, run, handle, max_in_flight=1, retire=True)
    # Files go after the commit of the micro-batch that took their last shard.
    assert all(n >= 3 - k // 2 for k, n in enumerate(left)) and left[-1] < 3
    S.sweep_store(spark, path)
    assert data_files(path) == [] and source.index_of(spark, path).count() == 0 and source.read_store(spark, path).count() == 0
    sink.publish(samples(spark, [7, 3]), path)
    assert rows(source.read_store(spark, path)) == rows(samples(spark, [3, 7]))


def test_a_stopped_retirement_is_finished_by_the_next(spark):
    path = store(spark, range(6), file_bytes=2 * 8 * 48)
    held = source.Store(path)
    source._put(held, {"next": 4, "version": 1, "done": {"next": 0, "version": 0}})  # said, not done
    assert {r.shard_id for r in source.read_store(spark, path).collect()} == {4, 5}
    assert source.retire_taken(held, {"next": 4, "version": 1}) == 2 and len(data_files(path)) == 1
    assert source.retire_taken(held, {"next": 6, "version": 1}) == 1


def test_a_live_run_ends_by_the_marker(spark):
    path, run = sink.create_store(spark, fresh_dir(spark, "store")), fresh_dir(spark, "run")
    seen = []
    query = S.consume_store(spark, path, run, lambda b, i: seen.append(sorted({r.shard_id for r in b.collect()})), gaps="wait", max_in_flight=2, interval="100 milliseconds")
    publisher = S.publish_paced(samples(spark, range(5)), path, f"{run}/publisher", 2, "200 milliseconds")
    S.run_until_end(spark, path, query)
    publisher.stop()
    assert [s for batch in seen for s in batch] == list(range(5)) and all(len(b) <= 2 for b in seen)
    assert not query.isActive and sink.store_ended(spark, path)


def test_a_failing_live_run_raises(spark):
    path, run = store(spark, [0]), fresh_dir(spark, "run")

    def fails(batch, batch_id):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        S.run_until_end(spark, path, S.consume_store(spark, path, run, fails))


def test_phase_log_has_the_columns_of_the_figures(spark):
    from millrace.operators.metrics import run_totals

    path, run = store(spark, range(5)), fresh_dir(spark, "run")
    S.drain_store(spark, path, run, S.phase_log_handler(lambda b, i: b.count(), f"{run}/log", "r"), max_in_flight=2)
    log = spark.read.schema(S.PHASE_COLUMNS).parquet(f"{run}/log")
    got = sorted(log.collect(), key=lambda r: r.shard_id)
    assert [(r.shard_id, r.n, r.bytes) for r in got] == [(k, 8, 8 * 48) for k in range(5)]
    assert all(r.load_ms > 0 and r.train_ms > 0 for r in got) and [r.wait_ms > 0 for r in got] == [True, False, True, False, True]
    totals = run_totals(log.withColumns({"run": F.lit(1), "loss": F.lit(0.0), "correct": F.lit(0)}), ["run"]).first()
    assert totals["shards"] == 5 and totals["samples"] == 40


def test_small_files_appear_once(spark):
    path = qualified(spark, fresh_dir(spark, "small")) + "/x.json"
    assert path.startswith("file:") and not exists(spark, path)
    publish_text(spark, path, json.dumps({"a": 1}))
    with pytest.raises(FileExistsError):
        publish_text(spark, path, "other")
    with open(local_path(path)) as f:
        assert json.load(f) == {"a": 1}
    assert [n for n in os.listdir(os.path.dirname(local_path(path))) if n.endswith(".tmp")] == []


@pytest.mark.parametrize("kind", ["typed", "raw"])
@pytest.mark.parametrize("file_bytes", [sink.FILE_BYTES, 8 * 8 * 6])
def test_a_few_shards_are_published_as_many_are(spark, kind, file_bytes):
    """Same rows and index whether sizes go through the driver or through tables, in one file or in several."""
    found = []
    for few in (False, True):
        path = store(spark, (0, 1, 2), (7, 5), kind=kind, few=few, file_bytes=file_bytes)
        index = source.index_of(spark, path).orderBy("shard_id").drop("file", "published_us").collect()
        back = source.read_store(spark, path) if kind == "typed" else unpack_shards(shape_raw(source.read_raw_store(spark, path), TINY)[0])
        found.append(([tuple(r) for r in index], rows(back), taken(spark, path, fresh_dir(spark, "run"), kind=kind, max_in_flight=2)))
        with pytest.raises(ValueError, match="allowed"):
            sink.publish(samples(spark, (9,)), path, kind, cap=8 * 8 * 6, few=few)
    assert found[0] == found[1] and found[0][2] == [[0, 1], [2, 5], [7]]
    empty = store(spark, kind=kind)
    assert sink.publish(samples(spark, (0,)).where("false"), empty, kind, few=True).count() == 0


def test_one_shard_is_read_without_its_whole_file(spark, monkeypatch):
    """Files have row groups of about GROUP_BYTES, so a reader of one shard decodes few others."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(sink, "GROUP_BYTES", 4096)
    path = sink.create_store(spark, fresh_dir(spark, "store"))
    wide = FeedConfig(batch_size=64, seq_len=64, vocab=5000)
    sink.publish(synth_uniform(spark, 32, 64, wide), path)
    (file,) = data_files(path)
    (name,) = [os.path.join(d, file) for d, _, names in os.walk(local_path(path) + "/data") if file in names]
    groups = pq.ParquetFile(name).metadata
    assert groups.num_row_groups > 8 and max(groups.row_group(g).num_rows for g in range(groups.num_row_groups)) < 64 * 4
    held = source.Store(qualified(spark, path))
    row = held.rows(held.newest(), 9, 10).to_pylist()[0]
    got = list(source.read_rows(held, row["file"], [(9, row["first"], row["size"])]))
    assert sum(b.num_rows for b in got) == 64 and {n for b in got for n in b.column("shard_id").to_pylist()} == {9}


def test_spans_are_read_by_the_index(spark):
    """Only files of the span are opened, and none that were retired."""
    path = store(spark, (0, 1, 2, 3), (4, 5), file_bytes=2 * 8 * 8 * 6)
    assert len(data_files(path)) == 3
    span = source.read_store(spark, path, 2, 4)
    assert len(span.inputFiles()) == 2 and {r.shard_id for r in span.collect()} == {2, 3, 4}
    assert source.shards_between(spark, path, 1, 4) == [1, 2, 3, 4] and source.shards_between(spark, path, 6, 9) == []
    source.retire_taken(source.Store(qualified(spark, path)), {"next": 4, "version": 2})
    assert {r.shard_id for r in source.read_store(spark, path, 0, 9).collect()} == {4, 5}
    assert source.read_store(spark, path, 0, 3).count() == 0


def test_raw_words_of_a_file_are_shared_out_to_tasks():
    size = source.PIECE_BYTES // 4
    cut = source._cut([(i, i * size, size) for i in range(16)])
    assert [len(run) for run in cut] == [4, 4, 4, 4] and [s[0] for run in cut for s in run] == list(range(16))
    many = source._cut([(i, i * size, size) for i in range(1000)])
    assert len(many) == source.PIECES and [s[0] for run in many for s in run] == list(range(1000))
    assert source._cut([(0, 0, 9 * source.PIECE_BYTES)]) == [[(0, 0, 9 * source.PIECE_BYTES)]]


def test_a_few_shards_are_published_in_one_job(spark):
    """One task looks at their sizes and writes them, and index files are merged by the driver."""
    path, context = sink.create_store(spark, fresh_dir(spark, "store")), spark.sparkContext
    held = samples(spark, range(8)).localCheckpoint()
    context.setJobGroup("few", "few")
    try:
        for k in range(0, 8, 2):
            sink.publish_few(held.where(F.col("shard_id").between(k, k + 1)), path, merge_at=2)
        assert len(context.statusTracker().getJobIdsForGroup("few")) == 4
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    index = source.index_of(spark, path).orderBy("shard_id").collect()
    assert [(r.shard_id, r.version, r.n, r.bytes) for r in index] == [(s, 1 + s // 2, 8, 8 * 48) for s in range(8)]
    assert len(source.Store(qualified(spark, path)).newest()["index"]) <= 2
    assert rows(source.read_store(spark, path)) == rows(held)


def test_written_is_not_yet_published(spark):
    path = store(spark, [0])
    written = sink.write_few(samples(spark, [3, 1]), path)
    assert [r["shard_id"] for r in written.to_pylist()] == [1, 3] and len(data_files(path)) == 2
    assert source.shards_between(spark, path, 0, 9) == [0] and source.read_store(spark, path, 0, 9).count() == 8
    assert sink.publish_written(spark, written, path)["shard_id"].to_pylist() == [1, 3]
    assert rows(source.read_store(spark, path, 0, 9)) == rows(samples(spark, [0, 1, 3]))
    # More than a task may hold is left to be published as many are, and what has no shard is not published.
    assert sink.write_few(samples(spark, [4, 5]), path, file_bytes=8 * 48)["file"].to_pylist() == [None, None] and len(data_files(path)) == 2
    odd = samples(spark, [6]).withColumn("shard_id", F.when(F.col("pos_in_shard") > 2, F.col("shard_id")))
    assert sink.publish_few(odd, path).select(["shard_id", "n"]).to_pylist() == [{"shard_id": 6, "n": 5}]


def test_a_span_of_whole_files_needs_no_filter(spark):
    path = store(spark, (0, 1, 2, 3), (4, 5), file_bytes=2 * 8 * 8 * 6)

    def filtered(low, high):
        span = source.read_store(spark, path, low, high)
        assert rows(span) == rows(samples(spark, range(low, high + 1)))
        return "Filter" in span._jdf.queryExecution().optimizedPlan().toString()

    assert [filtered(*span) for span in ((0, 1), (2, 5), (4, 5), (1, 3), (2, 4), (1, 1))] == [False, False, False, True, True, True]

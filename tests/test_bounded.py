"""Shards held back behind a lookahead, and the live backlog, against plain loops."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import timeline
from millrace.session import fresh_dir, local_path
from millrace.streaming import bounded
from millrace.streaming.feed import keep_metrics, run_stream

EVENTS = "stream bigint, shard_id bigint, kind string"


def drain(stream, run, handler):
    run_stream(stream, handler, f"{run}/checkpoint").awaitTermination()


def test_gate_against_the_rule():
    """Any order of events: a number is released as soon as all before it are and the one ``lookahead`` places earlier is gone."""
    r = random.Random(5)
    for lookahead in (0, 1, 3):
        gate, ready, gone, out = bounded.Gate(lookahead), set(), set(), []
        for _ in range(400):
            if r.random() < 0.5:
                number = r.randint(0, len(out) + 12)
                ready.add(number)
                gate.ready(number)
            elif out:
                number = r.choice(out)
                gone.add(number)
                gate.retired(number)
            gate = bounded.Gate(lookahead, *gate.state())  # as kept between micro-batches
            for number in gate.release():
                assert number == len(out) and number in ready and (not lookahead or number < lookahead or number - lookahead in gone)
                out.append(number)
            n = len(out)
            assert n not in ready or lookahead and n >= lookahead and n - lookahead not in gone
            following, in_flight, lows, highs = gate.state()
            assert following == n and len(in_flight) <= lookahead and (not lookahead or set(in_flight) == set(out) - gone)
            assert {x for a, b in zip(lows, highs) for x in range(a, b + 1)} == {x for x in ready if x >= n}
            assert all(b + 1 < a for b, a in zip(highs, lows[1:]))
        assert len(out) > 10


def test_held_back_in_a_stream(spark):
    path, run = fresh_dir(spark, "events"), fresh_dir(spark, "run")
    batches = [
        [(s, i, "ready") for s in (1, 2) for i in (4, 0, 2, 1, 3)] + [(1, None, "ready"), (1, 7, "other"), (None, 0, "ready")],
        [(1, 0, "retired"), (1, 0, "retired"), (2, 1, "retired")],
        [(1, 2, "retired"), (1, 1, "retired"), (2, 0, "retired"), (1, 0, "ready")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/batch={k}")
        seen = []
        stream = bounded.hold_back(spark.readStream.schema(EVENTS).parquet(f"{path}/*"), "stream", 2)
        drain(stream, run, lambda b, i: seen.extend((r.stream, r.shard_id, r.kind) for r in b.collect()))
        want = [
            {(1, 0), (1, 1), (2, 0), (2, 1), (None, 0)},
            {(1, 2)},
            {(1, 3), (1, 4), (2, 2), (2, 3)},
        ][k]
        assert {(s, i) for s, i, _ in seen} == want and len(seen) == len(want) and {kind for *_, kind in seen} == {"release"}


def test_a_stall_is_told(spark):
    path, run = fresh_dir(spark, "events"), fresh_dir(spark, "run")
    spark.createDataFrame([(1, 0, "ready"), (1, 1, "ready")], EVENTS).coalesce(1).write.parquet(path)
    seen = []
    stream = bounded.hold_back(spark.readStream.schema(EVENTS).parquet(path), "stream", 1, stall="1 second")
    query = run_stream(stream, lambda b, i: seen.extend((r.shard_id, r.kind) for r in b.collect()), f"{run}/checkpoint", "300 milliseconds")
    for _ in range(200):
        if (1, "stall") in seen or query.awaitTermination(0.2):
            break
    query.stop()
    assert seen[0] == (0, "release") and (1, "stall") in seen and (1, "release") not in seen


@pytest.mark.parametrize("delay", ["1000 days", "20 seconds"])
def test_live_backlog_ends_as_the_table_says(spark, delay):
    r = random.Random(9)
    published, retired = [], []
    for stream in (1, 2, 3):
        at = 1_000_000_000
        for shard in range(40):
            at += r.randint(0, 2_000_000)
            published.append((stream, shard, at, 100 + shard))
            retired.append((stream, shard, at + r.randint(0, 9_000_000), 100 + shard))
    kinds = "stream bigint, shard_id bigint, ts_us bigint, bytes bigint"
    held = timeline.backlog(spark.createDataFrame(published, kinds), spark.createDataFrame(retired, kinds), "stream")
    want = {row.stream: (row.peak_items, row.peak_bytes) for row in timeline.backlog_peak(held, "stream").collect()}
    changes = [(s, i, t, 1, b) for s, i, t, b in published] + [(s, i, t, -1, -b) for s, i, t, b in retired]
    # About in the order of time: nothing is more than 16 seconds late.
    changes.sort(key=lambda c: c[2] + r.randint(0, 8_000_000))
    path, run = fresh_dir(spark, "changes"), fresh_dir(spark, "run")
    schema = "stream bigint, shard_id bigint, ts_us bigint, delta bigint, bytes bigint"
    for k in range(6):
        spark.createDataFrame(changes[40 * k : 40 * k + 40], schema).coalesce(1).write.parquet(f"{path}/part={k}")
    live = bounded.live_backlog(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"), "stream", delay)
    query, newest = keep_metrics(live, run, ["stream"])
    query.awaitTermination()
    got = {row.stream: row for row in newest().collect()}
    assert {s: (row.peak_items, row.peak_bytes) for s, row in got.items()} == want
    assert all(row["items"] == 0 and row.bytes_held == 0 for row in got.values())
    assert all((row.waiting < 80) == (delay == "20 seconds") for row in got.values())


def test_held_figures_against_a_loop():
    r = random.Random(3)
    changes = [(at, r.choice((1, -1)), at, r.randint(-5, 5)) for at in range(50)]
    held = bounded.Held(2, 7, 3, 9)
    items, size, peaks = 2, 7, [3, 9]
    for part in (changes[:20], changes[20:20], changes[20:]):
        held.take(np.array(part, np.int64).reshape(-1, 4))
        for _, delta, _, b in part:
            items, size = items + delta, size + b
            peaks = [max(peaks[0], items), max(peaks[1], size)]
        assert held.figures() == (items, size, *peaks)


def test_state_partitions_go_by_the_stream_not_by_the_session(spark):
    """They are set where the stream starts, and the session keeps its own."""
    from millrace.session import shuffles_of

    path, run = fresh_dir(spark, "events"), fresh_dir(spark, "run")
    spark.createDataFrame([(0, i, "ready") for i in range(5)], EVENTS).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    with shuffles_of(spark, 1):
        query = run_stream(bounded.hold_back(spark.readStream.schema(EVENTS).parquet(path), "stream", 2), lambda b, i: seen.extend(b.collect()), f"{run}/c")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    query.awaitTermination()
    assert [r.shard_id for r in seen] == [0, 1]
    state = local_path(f"{run}/c/state/0")
    assert [d for d in os.listdir(state) if d.isdigit()] == ["0"]

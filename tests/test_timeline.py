from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import timeline as T
from millrace.session import stage

ARRIVALS = "stream int, event_id int, shard_id int, ts_us bigint, service_us bigint, bytes bigint"
ORDER = ["ts_us", "event_id"]


def arrivals(seed, n=150, gap=40, hot=0.7):
    rng = random.Random(seed)
    clock, rows = 0, []
    for i in range(n):
        clock += rng.choice([0, 1, gap])
        stream = 0 if rng.random() < hot else rng.randrange(1, 9)
        rows.append((stream, i, i, clock, rng.randrange(1, 60), rng.randrange(1, 9) * 100))
    return rows


def one_at_a_time(rows):
    """The same by a sequential loop."""
    free, out = {}, {}
    for stream, i, _, ts, service, _ in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        last = free.get(stream)
        start = ts if last is None else max(ts, last)
        out[i] = (start, start + service, 0 if last is None else start - last, start - ts)
        free[stream] = start + service
    return out


@pytest.mark.parametrize("gap", [0, 5, 40, 4000])
def test_starvation_is_the_sequential_loop(spark, many_ranges, gap):
    rows = arrivals(gap, gap=gap)
    got = T.starvation(spark.createDataFrame(rows, ARRIVALS), "stream", ORDER)
    found = {r["event_id"]: (r["start_us"], r["finish_us"], r["wait_us"], r["queue_us"]) for r in got.collect()}
    assert found == one_at_a_time(rows)


def test_starvation_does_not_depend_on_ranges(spark):
    rows = arrivals(9)
    df = spark.createDataFrame(rows, ARRIVALS).repartition(17)
    found = {r["event_id"]: r["finish_us"] for r in T.starvation(df, "stream", ORDER).collect()}
    assert found == {k: v[1] for k, v in one_at_a_time(rows).items()}


def test_arrivals_at_once_and_far_apart(spark):
    def waits(step):
        rows = [(0, i, i, i * step, 10, 1) for i in range(5)]
        out = T.starvation(spark.createDataFrame(rows, ARRIVALS), "stream", ORDER).orderBy("event_id")
        return [r["wait_us"] for r in out.collect()]

    assert waits(0) == [0] * 5
    assert waits(100) == [0, 90, 90, 90, 90]


@pytest.mark.parametrize("start", [0, 900])
def test_first_wait_counts_from_the_start_of_the_run(spark, many_ranges, start):
    """A loop whose consumer is ready from the start on; it may start after some arrivals."""
    rows = arrivals(5)
    free, want = {}, {}
    for stream, i, _, ts, service, _ in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        ready = free.get(stream, start)
        begin = max(ts, ready)
        want[i] = (begin, begin + service, begin - ready)
        free[stream] = begin + service
    got = T.starvation(spark.createDataFrame(rows, ARRIVALS), "stream", ORDER, start)
    assert {r["event_id"]: (r["start_us"], r["finish_us"], r["wait_us"]) for r in got.collect()} == want
    again = T.consumer_wait(got.withColumnRenamed("wait_us", "w"), "stream", ORDER, start)
    assert again.where(F.col("w") != F.col("wait_us")).count() == 0
    for r in T.starvation_ratio(got, "stream", start).collect():
        mine = [i for i, row in enumerate(rows) if row[0] == r["stream"]]
        assert r["starvation"] == pytest.approx(sum(want[i][2] for i in mine) / (max(want[i][1] for i in mine) - start))


def test_consumer_wait_is_the_wait_of_the_schedule(spark, many_ranges):
    log = T.starvation(spark.createDataFrame(arrivals(4), ARRIVALS), "stream", ORDER)
    again = T.consumer_wait(log.withColumnRenamed("wait_us", "w"), "stream", ORDER)
    assert again.where(F.col("w") != F.col("wait_us")).count() == 0


def served(spark, seed):
    return stage(T.starvation(spark.createDataFrame(arrivals(seed), ARRIVALS), "stream", ORDER))


def test_backlog(spark, many_ranges):
    log = served(spark, 6)
    rows = log.collect()
    held = T.backlog(
        log.select("stream", "shard_id", "ts_us", "bytes"),
        log.select("stream", "shard_id", F.col("finish_us").alias("ts_us"), "bytes"),
        "stream",
    )
    changes = [(r["stream"], r["ts_us"], 1, r["shard_id"], r["bytes"]) for r in rows]
    changes += [(r["stream"], r["finish_us"], -1, r["shard_id"], -r["bytes"]) for r in rows]
    want, items, size = {}, {}, {}
    for s, ts, d, i, b in sorted(changes):
        items[s], size[s] = items.get(s, 0) + d, size.get(s, 0) + b
        want[(i, d)] = (items[s], size[s])
    got = {(r["shard_id"], r["delta"]): (r["items"], r["bytes_held"]) for r in held.collect()}
    assert got == want

    peaks = {r["stream"]: r["peak_items"] for r in T.backlog_peak(held, "stream").collect()}
    least = {r["stream"]: r["least_lookahead"] for r in T.least_lookahead(held, "stream").collect()}
    assert least == peaks
    feed = log.select("stream", *ORDER, F.col("ts_us").alias("publish_us"), F.col("finish_us").alias("retire_us"))
    # The peak of the hot stream is a limit nothing breaks, one less is broken.
    for limit, broken in ((peaks[0], False), (peaks[0] - 1, peaks[0] > 1)):
        audit = T.lookahead_audit(feed.where("stream = 0"), "stream", ORDER, limit)
        assert (audit.where("violation").count() > 0) == broken
    fits = T.capacity_audit(held, 700)
    for r in fits.collect():
        before = want[(r["shard_id"], 1)][1] - r["bytes"]
        assert r["held_before"] == before and r["fits"] == (700 - before > r["bytes"])
    few = T.capacity_audit(held, 10**9, 3)
    for r in few.collect():
        assert r["fits"] == (3 - (r["items"] - 1) > 1)


def test_retire_frees_first(spark):
    log = "stream int, shard_id int, ts_us bigint, bytes bigint"
    published = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 10, 5)], log)
    retired = spark.createDataFrame([(0, 0, 10, 5), (0, 1, 20, 5)], log)
    held = T.backlog(published, retired, "stream")
    assert T.backlog_peak(held, "stream").first()["peak_items"] == 1


def test_lookahead(spark):
    rows = [(0, 0, 0, 5), (0, 1, 1, 6), (0, 2, 4, None), (0, 3, 6, None)]
    log = spark.createDataFrame(
        [(s, i, p, p, r) for s, i, p, r in rows], "stream int, event_id int, ts_us bigint, publish_us bigint, retire_us bigint"
    )

    def broken(limit):
        audit = T.lookahead_audit(log, "stream", ORDER, limit)
        return sorted(r["event_id"] for r in audit.where("violation").collect())

    assert broken(0) == []
    assert broken(1) == [1, 2, 3]  # shard 2 is still there when shard 3 appears
    assert broken(2) == [2]
    assert broken(3) == []


def test_small_ones(spark, many_ranges):
    rows = arrivals(2)
    df = spark.createDataFrame(rows, ARRIVALS)
    mine = sorted((r for r in rows if r[0] == 0), key=lambda r: (r[3], r[1]))
    only = lambda out: out.where("stream = 0").orderBy(*ORDER).collect()
    times = [r[3] for r in mine]
    assert [r["gap_us"] for r in only(T.publish_gap(df, "stream", ORDER))] == [a - b for a, b in zip(times, [0, *times])]
    assert [r["elapsed_us"] for r in only(T.elapsed(df, "stream", ORDER))] == [t - times[0] for t in times]
    assert [r["ordinal"] for r in only(T.shard_ordinal(df, "stream", ORDER))] == list(range(1, len(mine) + 1))
    sums = [sum(r[5] for r in mine[: i + 1]) for i in range(len(mine))]
    assert [r["total_bytes"] for r in only(T.running_totals(df, "stream", ORDER, ["bytes"]))] == sums


def test_unaccounted(spark):
    df = spark.createDataFrame([(1.0, 2.0, 10.0)], "a_ms double, b_ms double, wall_ms double")
    assert T.unaccounted_time(df, "wall_ms", ["a_ms", "b_ms"]).first()["unaccounted_ms"] == 7.0

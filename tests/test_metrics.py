from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.config import PHASES
from millrace.operators import metrics as M

LOG = "run int, phase string, ms double"


def distribution(values):
    vs = sorted(values)
    n = len(vs)
    late = vs[min(n - 1, int(0.95 * n))]
    return n, vs[0], statistics.median(vs), statistics.fmean(vs), late, vs[-1]


def measured(spark, values):
    log = spark.createDataFrame([(0, "wait", float(v)) for v in values], LOG)
    r = M.phase_distribution(log, ["run", "phase"]).first()
    return r["n"], r["min_ms"], r["p50_ms"], pytest.approx(r["mean_ms"]), r["p95_ms"], r["max_ms"]


@pytest.mark.parametrize("values", [[5], [1, 4], list(range(1, 21)), list(range(1, 101)), [3, 3, 3, 9]])
def test_distribution(spark, values):
    assert measured(spark, values) == distribution(values)


def test_twenty_values_take_the_last(spark):
    assert measured(spark, range(1, 21))[4] == 20.0


def test_distribution_in_many_ranges_with_a_hot_value(spark, many_ranges):
    rng = random.Random(5)
    data = [(r, p, float(rng.choice([0, 0, rng.randrange(300)]))) for r in range(3) for p in PHASES for _ in range(40)]
    data += [(7, "wait", float(i % 90)) for i in range(400)]
    got = M.phase_distribution(spark.createDataFrame(data, LOG), ["run", "phase"]).collect()
    assert len(got) == 16
    for r in got:
        values = [ms for run, phase, ms in data if (run, phase) == (r["run"], r["phase"])]
        want = distribution(values)
        assert (r["n"], r["min_ms"], r["p50_ms"], r["p95_ms"], r["max_ms"]) == (*want[:3], *want[4:])
        assert r["mean_ms"] == pytest.approx(want[3])


def test_approximate_form_has_the_same_columns(spark):
    log = spark.createDataFrame([(0, "wait", float(v)) for v in range(100)], LOG)
    exact = M.phase_distribution(log, ["run"])
    near = M.phase_distribution(log, ["run"], approx=True)
    assert near.columns == exact.columns and near.first()["p95_ms"] == pytest.approx(95, abs=1)


def shard_log(spark, rows):
    schema = "run int, n bigint, correct bigint, loss double, bytes bigint, " + ", ".join(f"{p}_ms double" for p in PHASES)
    return spark.createDataFrame(rows, schema)


def test_run_summary(spark):
    log = shard_log(spark, [(0, 2, 1, 0.5, 10, 1.0, 2.0, 3.0, 4.0, 5.0), (0, 6, 6, 0.1, 30, 1.0, 0.0, 0.0, 0.0, 5.0)])
    r = M.run_summary(log, F.lit(20.0)).first()
    assert (r["shards"], r["samples"], r["correct"], r["bytes"], r["status"]) == (2, 8, 7, 40, "done")
    assert r["final_loss"] == pytest.approx((0.5 * 2 + 0.1 * 6) / 8) and r["final_acc"] == 7 / 8
    assert (r["busy_frac"], r["stall_frac"], r["io_frac"]) == (0.5, 0.1, 0.45)
    assert (r["samples_per_s"], r["bytes_per_s"]) == (400.0, 2000.0)


def test_empty_run(spark):
    r = M.run_summary(shard_log(spark, []), F.lit(0.0)).first()
    assert (r["shards"], r["samples"], r["busy_frac"], r["final_loss"], r["status"]) == (0, 0, 0.0, 0.0, "no samples")
    phases = M.all_phases(M.phase_distribution(spark.createDataFrame([], LOG), ["phase"])).collect()
    assert sorted(p["phase"] for p in phases) == sorted(PHASES) and all(p["n"] == 0 for p in phases)


def test_weighted_mean_and_accuracy_of_nothing(spark):
    none = spark.createDataFrame([], "v double, w bigint")
    r = none.agg(M.weighted_mean(F.col("v"), F.col("w")).alias("m"), M.accuracy(F.col("v") > 0).alias("a")).first()
    assert (r["m"], r["a"]) == (0.0, 0.0)


def test_pivot_and_back(spark):
    log = spark.createDataFrame([(0, "wait", 1.5), (0, "wait", 2.0), (1, "train", 4.0)], LOG)
    wide = M.phase_columns(log, ["run"])
    long = {(r["run"], r["phase"]): r["ms"] for r in M.phase_rows(wide, ["run"]).collect()}
    assert len(long) == 10 and long[(0, "wait")] == 3.5 and long[(1, "train")] == 4.0 and long[(1, "h2d")] == 0.0


def test_rate_every_k(spark, many_ranges):
    log = spark.createDataFrame([(0, i, 100 * (i + 1), 50) for i in range(25)], "s int, i int, ts_us bigint, bytes bigint")
    got = sorted(M.rate_every_k(log, "s", ["ts_us", "i"], k=10).collect(), key=lambda r: r["grp"])
    assert [(r["grp"], r["bytes"], r["from_us"], r["to_us"]) for r in got] == [(0, 500, 0, 1000), (1, 500, 1000, 2000)]
    # 500 bytes in a millisecond are half a megabyte a second.
    assert [r["mb_per_s"] for r in got] == [pytest.approx(0.5)] * 2

"""Every registered query against its SQL, on whole tables; and plans that must hold at any size."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import connect, differences

import __spark_entry__ as entry
from millrace.operators.ordered import ROWS_SETTING

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()
# Queries built on running values: run again with the tables cut into many ranges.
CUT = [
    "doc_shard_manifest", "assign_shards", "shard_order", "shuffle_in_shard", "phase_distribution",
    "phase_distribution_all", "rate_every_k", "publish_gap", "elapsed", "running_totals",
    "shard_ordinal", "starvation", "starvation_ratio", "consumer_wait", "backlog", "backlog_peak",
    "lookahead_audit", "least_lookahead", "capacity_audit", "cross_check", "stream_ordered",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["shard_id", "n_samples", "n_tokens", "n_bytes", "n_pos"] and df.count() > 0


def test_names():
    assert set(ORACLES) < set(QUERIES)
    feed = {name for name in QUERIES if name != "pipeline" and not name[2:3].isdigit()}
    assert feed - set(ORACLES) == {"fit_classifier"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert differences(spark, duck, SMALL, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", CUT)
def test_same_rows_in_many_ranges(spark, duck, name):
    spark.conf.set(ROWS_SETTING, "60")
    try:
        assert differences(spark, duck, SMALL, QUERIES[name], ORACLES[name]) is None
    finally:
        spark.conf.unset(ROWS_SETTING)


def test_both_ways_of_training_agree(spark):
    """Both go by shard number, so losses agree too."""
    table = {r["shard_id"]: (r["n"], r["correct"], r["loss"]) for r in QUERIES["train_over_shards"](spark, SMALL).collect()}
    stream = {r["shard_id"]: (r["n"], r["correct"], r["loss"]) for r in QUERIES["stream_train"](spark, SMALL).collect()}
    assert table.keys() == stream.keys()
    for shard, figures in table.items():
        assert stream[shard] == pytest.approx(figures, abs=2e-6)


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["assign_shards", "starvation", "backlog", "rate_every_k", "cross_check", "score", "run_totals", "shape_check"]
)
def test_no_products_and_no_python_in_hot_paths(spark, name):
    spark.conf.set(ROWS_SETTING, "60")
    try:
        lines = plan(spark, name).splitlines()
    finally:
        spark.conf.unset(ROWS_SETTING)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"):
        assert not any(word in line for line in lines)
    # One task may hold the summary of the ranges, of which there are at most MAX_RANGES, and nothing else.
    for line, below in zip(lines, lines[1:]):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[_range#" in below


@pytest.mark.parametrize("name", ["score", "pack_shards", "train_step_gradient", "doc_shard_manifest"])
def test_wide_rows_are_not_numbered_in_one_task(spark, name):
    """With the settings as they are: only summaries of ranges meet in one task."""
    lines = plan(spark, name).splitlines()
    for line, below in zip(lines, lines[1:]):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[_range#" in below or "HashAggregate(keys=[], functions=[partial_count(1)" in below


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "next_shard")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text


def test_large_byte_counts_do_not_overflow(spark, monkeypatch):
    """Above 2**63 bytes, where a product of long integers fails."""
    from millrace.plans import inputs

    batches = spark.createDataFrame([(36000, 1000, 4088), (2_000_000, 1000, 4088), (3, 10, 8), (0, 10, 0)], "shard_id bigint, n bigint, sample_size bigint")
    monkeypatch.setattr(inputs, "line_batches", lambda spark, sf_dir: batches)
    got = {r.shard_id: r.size for r in QUERIES["human_bytes"](spark, SMALL).collect()}
    want = {s: 1000 * 4088 * (s**3 + 1) / 1024**4 for s in (36000, 2_000_000)}
    assert got == {s: f"{v:6.1f} TiB" for s, v in want.items()} | {3: "   2.2 KiB", 0: "   0.0 B"}

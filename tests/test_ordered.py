from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered as O
from millrace.operators.batching import assign_shards


def rows(seed, n=200):
    """One group with more than half of all rows, some small ones, one without a name."""
    rng = random.Random(seed)
    groups = ["hot"] * (n * 6 // 10) + [None] * 5 + [f"g{rng.randrange(30)}" for _ in range(n * 4 // 10)]
    return [(g, rng.randrange(20), i, rng.randrange(-50, 50) if i % 9 else None) for i, g in enumerate(groups)]


def expected(data):
    out = {}
    groups = {}
    for g, t, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        seen = groups.setdefault(g, [])
        seen.append((t, i, v))
        known = [w for *_, w in seen if w is not None]
        out[i] = (
            len(seen),
            sum(known) if known else None,
            max(known) if known else None,
            min(known) if known else None,
            seen[-2][2] if len(seen) > 1 else None,
        )
    totals = {g: sum(v for *_, v in s if v is not None) for g, s in groups.items()}
    return {i: (*out[i], totals[g] if any(v is not None for *_, v in groups[g]) else None) for g, _, i, _ in data}


@pytest.mark.parametrize("parts", [1, 17])
@pytest.mark.parametrize("seed", [1, 2])
def test_running_columns(spark, many_ranges, seed, parts):
    data = rows(seed)
    df = spark.createDataFrame(data, "g string, t int, i int, v bigint").repartition(parts)
    v = F.col("v")
    out = O.running_columns(
        df,
        ["g"],
        ["t", "i"],
        {
            "pos": O.ordinal(),
            "s": O.running_sum(v),
            "hi": O.running_max(v),
            "lo": O.running_min(v),
            "before": O.previous(v),
            "all": O.group_total(v),
        },
    )
    assert out.columns == ["g", "t", "i", "v", "pos", "s", "hi", "lo", "before", "all"]
    got = {r["i"]: (r["pos"], r["s"], r["hi"], r["lo"], r["before"], r["all"]) for r in out.collect()}
    assert got == expected(data)


def test_ranges_are_balanced_and_carries_are_few(spark, many_ranges):
    df = spark.createDataFrame(rows(3, 2000), "g string, t int, i int, v bigint")
    ranged, n = O.with_range(df, ["g", "t", "i"])
    sizes = [r["count"] for r in ranged.groupBy(O.RANGE).count().collect()]
    assert n > 100 and len(sizes) <= n and max(sizes) < 2000 / 20
    summary = ranged.groupBy(O.RANGE, "g").agg(F.count("*").alias("c"))
    carry = O.carried(summary, ["g"], {"c0": F.sum("c").over(O.earlier(["g"]))})
    assert carry.count() <= 2 * (n - 1)


def test_dense_index(spark, many_ranges):
    df = spark.range(500).select((F.col("id") * 37 % 1000).alias("k"), F.lit(1).alias("same"))
    got = O.dense_index(df, ["same", "k"]).orderBy("k").collect()
    assert [r["idx"] for r in got] == list(range(500))


def test_keys_of_all_kinds(spark, many_ranges):
    df = spark.range(100).select(
        (F.col("id") % 7 / 3.0).alias("d"),
        F.concat(F.lit('q"\\'), F.col("id").cast("string")).alias("s"),
        F.timestamp_micros(F.col("id") * 77).cast("timestamp_ntz").alias("t"),
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"),
        "id",
    )
    keys = ["d", "n", "t", "s", "id"]
    got = O.dense_index(df, keys).select("idx", *keys).collect()
    order = sorted(got, key=lambda r: tuple((v is not None, v) if v is not None else (False,) for v in [r[k] for k in keys]))
    assert [r["idx"] for r in order] == list(range(100))


def test_assign_shards_across_ranges(spark, many_ranges):
    out = assign_shards(spark.range(100).withColumnRenamed("id", "k"), ["k"], 16)
    for r in out.collect():
        assert (r["sample_id"], r["shard_id"], r["pos_in_shard"]) == (r["k"], r["k"] // 16, r["k"] % 16)


def test_empty(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert O.dense_index(empty, ["k"]).count() == 0

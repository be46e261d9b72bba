from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.operators import model as M
from millrace.operators.batching import minibatches, shuffle_within_shard
from millrace.session import fresh_dir, stage
from millrace.sources.synth import synth_uniform

TINY = FeedConfig(batch_size=8, seq_len=6, vocab=12)


def array_of(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_loss_and_prediction(spark):
    y1 = F.lit(1)
    assert one(spark, M.cross_entropy(array_of(0, 0), y1)) == pytest.approx(math.log(2))
    assert one(spark, M.cross_entropy(array_of(5000, -5000), y1)) == pytest.approx(10000)
    assert one(spark, M.predict(array_of(1, 1))) == 0
    assert one(spark, M.predict(array_of(-2, 1, 1))) == 1
    assert one(spark, M.probabilities(array_of(0, math.log(3)))) == pytest.approx([0.25, 0.75])


def test_only_padding_scores_the_bias(spark):
    samples = spark.createDataFrame([(0, [0, 0], 1)], "sample_id bigint, x array<bigint>, y bigint")
    state = spark.createDataFrame([(M.BIAS, [0.5, -0.5]), (0, [9.0, 9.0])], "token bigint, w array<double>")
    assert M.score(samples, state, TINY).first()["logits"] == [0.5, -0.5]


ODD_ROWS = [(0, [0, 0], 1), (1, [5, 3, 5, 0, 17, 3, 12], 0), (2, [], 1), (3, None, 0), (4, [None, 4], 1), (5, [-1], 0)]


def test_sparse_rows(spark):
    """Clamped, ascending and counted; padding, ids that clamp to it, nulls and rows of nothing else have no entries."""
    samples = spark.createDataFrame(ODD_ROWS, "sample_id bigint, x array<bigint>, y bigint")
    got = {r["sample_id"]: [tuple(e) for e in r["counts"]] for r in M.sparse_rows(samples, TINY, "sample_id").collect()}
    assert got == {0: [], 1: [(3, 2), (5, 3)], 2: [], 3: [], 4: [(4, 1)], 5: [(11, 1)]}


@pytest.mark.parametrize("fits", [True, False])
def test_scores_by_projection_and_by_join(spark, monkeypatch, fits):
    samples = spark.createDataFrame(ODD_ROWS, "sample_id bigint, x array<bigint>, y bigint")
    state = spark.createDataFrame(
        [(M.BIAS, [0.5, -0.5]), (0, [9.0, 9.0]), (3, [1.0, 2.0]), (5, [10.0, 20.0])], "token bigint, w array<double>"
    )
    monkeypatch.setattr(M, "fits_one_job", lambda config: fits)
    got = {r["sample_id"]: r["logits"] for r in M.score(samples, state, TINY).collect()}
    assert got == {i: [32.5, 63.5] if i == 1 else [0.5, -0.5] for i in range(6)}
    empty = M.score(samples, M.zero_state(spark), TINY, "x")
    assert {tuple(r["logits"]) for r in empty.collect()} == {(0.0, 0.0)}
    assert M.score(samples.limit(0), state, TINY).collect() == []


def test_a_score_moves_no_row(spark, capsys):
    """Nothing of the samples is shuffled, exploded or joined, and no row carries the weights."""
    samples = stage(synth_uniform(spark, 2, 8, TINY, seed=2))
    state = spark.createDataFrame([(M.BIAS, [0.5, -0.5])], "token bigint, w array<double>")
    M.score(samples, state, TINY).explain("formatted")
    text = capsys.readouterr().out
    tree = text.split("\n\n")[0]
    assert "Scan parquet" in tree
    assert not any(word in tree for word in ("Exchange", "Generate", "Join", "Aggregate"))
    assert "_w0#" not in text


class Hand:
    """The same classifier and optimizer on dense arrays."""

    def __init__(self, config):
        shape = (config.vocab + 1, config.classes)
        self.w, self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), np.zeros(shape), 0

    def step(self, rows):
        self.t += 1
        n = len(rows)
        counts = np.zeros((n, len(self.w)))
        for i, (x, _) in enumerate(rows):
            counts[i, 0] = 1  # bias in the place of padding
            for t in x:
                counts[i, t + 1 if t else 0] += 1 if t else 0
        y = np.array([label for _, label in rows])
        z = counts @ self.w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[np.arange(n), y]).sum()
        correct = int((z.argmax(1) == y).sum())
        p[np.arange(n), y] -= 1
        g = counts.T @ p / n
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.w -= 1e-3 * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return loss, correct, n


@pytest.mark.parametrize("minibatch", [None, 3])
def test_training_is_the_hand_made_one(spark, minibatch):
    # Two and a half shards, so the last one is short.
    samples = synth_uniform(spark, 3, 8, TINY, seed=2).where("sample_id < 20")
    log, state = M.train_over_shards(samples, TINY, fresh_dir(spark, "t"), minibatch, seed=3)
    log = {r["shard_id"]: r for r in log.collect()}
    cut = minibatches(shuffle_within_shard(samples, 3), minibatch or 8)
    rows = {}
    for r in cut.collect():
        rows.setdefault((r["shard_id"], r["minibatch"]), []).append((r["x"], r["y"]))
    hand = Hand(FeedConfig(vocab=13))
    for shard in range(3):
        parts = [hand.step(rows[k]) for k in sorted(rows) if k[0] == shard]
        loss, correct, n = (sum(c) for c in zip(*parts))
        got = log[shard]
        assert got["n"] == n and got["correct"] == correct and got["bytes"] == n * TINY.sample_bytes
        assert got["loss"] == pytest.approx(loss / n, abs=1e-9)
        assert got["acc"] == pytest.approx(correct / n)
    for r in state.collect():
        row = 0 if r["token"] == M.BIAS else r["token"] + 1
        assert r["w"] == pytest.approx(hand.w[row].tolist(), abs=1e-9)


@pytest.mark.parametrize("minibatch", [None, 4, 50])
def test_every_row_of_a_large_shard_is_trained_on(spark, minibatch):
    # 20 rows in a shard of a feed with 8 to a batch, and numbers without a shard between two.
    rows = synth_uniform(spark, 5, 8, TINY, seed=4).where("sample_id < 27")
    shards = rows.withColumn("shard_id", F.when(F.col("sample_id") < 20, F.lit(3)).otherwise(F.lit(9)).cast("bigint"))
    log, _ = M.train_over_shards(shards, TINY, fresh_dir(spark, "t"), minibatch)
    got = {r["shard_id"]: (r["n"], r["bytes"]) for r in log.collect()}
    assert got == {3: (20, 20 * TINY.sample_bytes), 9: (7, 7 * TINY.sample_bytes)}


def test_loss_falls_on_separable_shards(spark):
    config = FeedConfig(batch_size=16, seq_len=4, vocab=20)
    ids = spark.range(96)
    y = F.col("id") % 2
    samples = ids.select(
        F.floor(F.col("id") / 16).alias("shard_id"),
        F.col("id").alias("sample_id"),
        (F.col("id") % 16).alias("pos_in_shard"),
        F.array_repeat(y * 5 + 3, 4).alias("x"),
        y.alias("y"),
    )
    log, _ = M.train_over_shards(samples, config, fresh_dir(spark, "t"))
    losses = [r["loss"] for r in log.orderBy("shard_id").collect()]
    assert losses[0] == pytest.approx(math.log(2))
    assert all(a > b for a, b in zip(losses, losses[1:]))
    assert log.where("shard_id = 5").first()["acc"] == 1.0


def test_no_shards_give_an_empty_log(spark):
    none = synth_uniform(spark, 1, 8, TINY).where("shard_id < 0")
    log, state = M.train_over_shards(none, TINY, fresh_dir(spark, "t"))
    assert log.count() == 0 and state.count() == 0


def test_whole_table_fit(spark):
    samples = synth_uniform(spark, 4, 16, TINY).withColumn("x", F.when(F.col("y") == 1, F.array_repeat(F.lit(7).cast("bigint"), 6)).otherwise(F.col("x")))
    _, scored = M.fit_classifier(samples, TINY)
    assert scored.where("prediction = label").count() > 0.9 * scored.count()


def test_steps_of_one_job(spark):
    """Two shards a step are one step over both; the packed state comes back; tokens are met by several tasks."""
    shards = synth_uniform(spark, 4, 8, TINY).repartition(5)
    one, two = M.Weights(TINY), M.Weights(TINY)
    first = M.train_step(shards.where("shard_id < 2"), one, TINY)
    assert [m["shard_id"] for m in first] == [0, 1] and all(m["n"] == 8 and m["loss"] == pytest.approx(math.log(2)) for m in first)
    joined = M.train_step(shards.where("shard_id < 2").withColumn("shard_id", F.lit(0).cast("bigint")), two, TINY)
    assert joined[0]["n"] == 16 and np.allclose(one.w, two.w) and one.seen.tolist() == two.seen.tolist()
    again = M.Weights(TINY).unpack(one.packed())
    assert again.step == 1 and all((getattr(again, k) == getattr(one, k)).all() for k in ("w", "m", "v", "seen"))
    by_table, _ = M.train_minibatch(shards.where("shard_id < 2"), M.zero_state(spark), 1, TINY, fresh_dir(spark, "state"))
    want = {r.token: r.w for r in by_table.collect()}
    got = {r.token: r.w for r in one.table(spark).collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    assert M.train_step(shards.where("shard_id > 9"), one, TINY) == [] and one.step == 1


def test_a_step_takes_two_jobs(spark):
    shards = stage(synth_uniform(spark, 6, 8, TINY), "shards")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("steps", "steps")
    try:
        M.train_over_shards(shards, TINY, fresh_dir(spark, "t"), shards_per_step=2)
        few = len(tracker.getJobIdsForGroup("steps"))
        spark.sparkContext.setJobGroup("more", "more")
        M.train_over_shards(shards, TINY, fresh_dir(spark, "t"), shards_per_step=1)
        many = len(tracker.getJobIdsForGroup("more"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Adaptive execution submits the shuffle of a gradient as a job of its own.
    assert many - few <= 3 * 3


def test_a_step_adds_up_few_tasks_as_it_shuffles_many(spark, monkeypatch):
    samples = stage(synth_uniform(spark, 4, 8, TINY).repartition(5))
    state = M.Weights(TINY)
    g, touched, metrics = M.step_sums(samples, state, TINY)
    monkeypatch.setattr(M, "FEW_TASKS", 0)
    g2, touched2, metrics2 = M.step_sums(samples, state, TINY)
    assert np.allclose(g, g2) and (touched == touched2).all() and [m["shard_id"] for m in metrics] == [0, 1, 2, 3]
    for a, b in zip(metrics, metrics2):
        assert a == pytest.approx(b) and a["n"] == 8


def test_training_by_spans_reads_the_same(spark):
    shards = stage(synth_uniform(spark, 5, 8, TINY))
    spans = []

    def span(low, high):
        spans.append((low, high))
        return shards.where(F.col("shard_id").between(low, high))

    plain, _ = M.train_over_shards(shards, TINY, fresh_dir(spark, "plain"), shards_per_step=2)
    spanned, _ = M.train_over_shards(shards, TINY, fresh_dir(spark, "spans"), shards_per_step=2, span=span)
    rows = [sorted((r.shard_id, r.batch_id, r.n, r.correct, round(r.loss, 9)) for r in log.collect()) for log in (plain, spanned)]
    assert rows[0] == rows[1] and spans == [(0, 1), (2, 3), (4, 4)]

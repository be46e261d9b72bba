from __future__ import annotations

from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.operators import batching as B
from millrace.operators import joins as J
from millrace.session import stage
from millrace.sources.synth import synth_uniform, with_stall

TINY = FeedConfig(batch_size=8, seq_len=5, vocab=50)


def as_set(df):
    return {(r["shard_id"], r["pos_in_shard"], tuple(r["x"]), r["y"]) for r in df.collect()}


def test_unpack_undoes_pack(spark):
    samples = synth_uniform(spark, 3, 8, TINY).where("sample_id < 21")
    assert as_set(B.unpack_shards(B.pack_shards(samples.repartition(5)))) == as_set(samples)


def test_next_and_order(spark):
    df = spark.createDataFrame([("a", 10, 1), ("a", 2, 2), ("b", 7, 3)], "s string, shard_id bigint, v int")
    assert {(r["s"], r["shard_id"], r["v"]) for r in B.next_shard(df, "s").collect()} == {("a", 2, 2), ("b", 7, 3)}
    assert [r["rank"] for r in B.order_shards(df).orderBy("shard_id").collect()] == [1, 2, 3]


def test_shuffle_is_repeatable_and_keeps_the_short_batch(spark):
    shards = synth_uniform(spark, 4, 10, TINY).select("shard_id", "sample_id")
    once = B.shuffle_within_shard(shards, 1)
    again = B.shuffle_within_shard(shards.repartition(17), 1)
    other = B.shuffle_within_shard(shards, 2)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(once) == key(again) != key(other)
    sizes = B.minibatches(once, 4).groupBy("shard_id", "minibatch").count().collect()
    assert sorted(r["count"] for r in sizes) == [2] * 4 + [4] * 8


def test_manifest(spark):
    m = B.shard_manifest(synth_uniform(spark, 2, 8, TINY)).collect()
    assert [(r["n_samples"], r["n_bytes"]) for r in m] == [(8, 8 * 48)] * 2
    assert all(0 <= r["n_tokens"] <= 40 and 0 <= r["n_pos"] <= 8 for r in m)


def test_generated_shards_can_be_made_again_alone(spark):
    whole = synth_uniform(spark, 6, 8, TINY, seed=4)
    alone = synth_uniform(spark, 6, 8, TINY, seed=4).repartition(13).where("shard_id = 5")
    assert as_set(alone) == as_set(whole.where("shard_id = 5"))
    assert as_set(whole) != as_set(synth_uniform(spark, 6, 8, TINY, seed=5))


def test_generated_tokens_are_spread_evenly(spark):
    tokens = synth_uniform(spark, 40, 50, FeedConfig(seq_len=20, vocab=10)).select(F.explode("x").alias("t"), "y")
    counts = [r["count"] for r in tokens.groupBy("t").count().collect()]
    assert len(counts) == 10 and all(3700 < c < 4300 for c in counts)
    assert 0.42 < tokens.select(F.avg("y")).first()[0] < 0.58


def test_stall_counts_as_waiting(spark):
    log = spark.createDataFrame([(0.5, 0.25), (0.0, 0.05)], "wait_s double, host_s double")
    got = [(r["wait_s"], r["load_s"]) for r in with_stall(log).collect()]
    assert got == [(0.6, 0.15), (0.1, 0.0)]


def test_cross_check(spark):
    published = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "run int, shard_id int, gap_us bigint")
    consumed = spark.createDataFrame([(0, 2, 4), (0, 3, 1)], "run int, shard_id int, wait_us bigint")
    got = {r["shard_id"]: (r["status"], r["gap_less_wait_us"]) for r in J.cross_check(published, consumed, ["run", "shard_id"]).collect()}
    assert got == {1: ("published only", None), 2: ("both", 2), 3: ("consumed only", None)}
    assert [r["shard_id"] for r in J.pending_shards(published, consumed, ["run", "shard_id"]).collect()] == [1]


def test_shape_check(spark):
    rows = [(0, 8, 8 * 48, 5), (1, 8, 8 * 48, 4), (2, 3, 3 * 48, 5), (3, 8, 100, 5)]
    manifest = spark.createDataFrame(rows, "shard_id int, n_samples bigint, n_bytes bigint, seq_len int")
    got = {r["shard_id"]: r["fault"] for r in J.shape_check(manifest, TINY).collect()}
    assert got == {1: "row length", 2: "samples", 3: "bytes"}
    last = manifest.where("shard_id < 3")  # now the short one is the last
    assert [r["shard_id"] for r in J.shape_check(last, TINY).collect()] == [1]


def test_embedding_lookup_broadcast_and_shuffled(spark, monkeypatch):
    table = spark.range(20).select(F.col("id").alias("token"), F.array_repeat(F.col("id").cast("float"), 3).alias("vec"))
    tokens = spark.createDataFrame([(s, p, t) for s in range(5) for p, t in enumerate([0, 7, 7, 19, 25])], "s int, p int, token bigint")
    want = {(s, p, tuple([float(t if t < 20 else 0)] * 3)) for s in range(5) for p, t in enumerate([0, 7, 7, 19, 25])}

    def found(df):
        return {(r["s"], r["p"], tuple(r["vec"])) for r in df.collect()}

    assert found(J.embedding_lookup(tokens, table, 3)) == want
    monkeypatch.setattr(J, "broadcast_if_small", lambda df: df)
    assert found(J.embedding_lookup(tokens, table, 3)) == want
    alone = J.embedding_lookup(tokens.select("token"), table, 3)
    assert sorted((r["token"], r["vec"][0]) for r in alone.collect()) == sorted((t, float(t if t < 20 else 0)) for t in [0, 7, 7, 19, 25] * 5)


def test_embedding_lookup_of_a_hot_token_in_buckets(spark, monkeypatch, capsys):
    """One token holds half of the rows. Its rows are not shuffled, and no vector is."""
    table = spark.range(3000).select(F.col("id").alias("token"), F.array_repeat(F.col("id").cast("float"), 3).alias("vec"))
    token = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 101 == 1, F.lit(None)).otherwise(F.col("id") % 4000)
    tokens = stage(spark.range(8000).select("id", token.cast("bigint").alias("token"), F.lit("kept").alias("extra")))
    monkeypatch.setattr(J, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(J, "HOT_SHARE", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vectors = J.bucketed_vectors(table, "lookup_vectors", 8)
        looked = J.embedding_lookup(tokens, vectors, 3)
        looked.explain("formatted")
        got = {r["id"]: (r["token"], r["vec"], r["extra"]) for r in looked.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS lookup_vectors")
    want = {r["id"]: r["token"] for r in tokens.collect()}
    assert len(got) == 8000
    for i, t in want.items():
        assert got[i] == (t, [float(t) if t is not None and t < 3000 else 0.0] * 3, "kept")
    tree = capsys.readouterr().out.split("\n\n")[0]
    # Of the plan's exchanges, one is of tokens that are not hot; the others are broadcasts of hot keys and their vectors.
    assert sum("Exchange" in line and "Broadcast" not in line for line in tree.splitlines()) == 1
    assert looked.columns == ["id", "token", "extra", "vec"]


def test_embedding_lookup_of_no_tokens(spark, monkeypatch):
    table = spark.range(5).select(F.col("id").alias("token"), F.array(F.col("id").cast("float")).alias("vec"))
    none = spark.range(0).select(F.col("id").alias("token"))
    assert J.embedding_lookup(none, table, 1).collect() == []
    monkeypatch.setattr(J, "broadcast_if_small", lambda df: df)
    assert J.embedding_lookup(none, table, 1).collect() == []

"""Queries over shard names, sizes, words, tokens, numbering and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.functions.columns import (
    batch_bytes,
    clamp_labels,
    clamp_tokens,
    human_bytes,
    is_leftover,
    is_publishable,
    load_time,
    reshape_words,
    sample_bytes,
    shard_index,
    split_valid,
    to_ms,
    token_ids,
)
from millrace.operators.batching import (
    minibatches,
    next_shard,
    order_shards,
    pack_shards,
    shard_manifest,
    shuffle_within_shard,
    unpack_shards,
)
from millrace.operators.joins import unlabelled
from millrace.plans import inputs
from millrace.plans.registry import ALL_SAMPLES, ARRIVALS, DOC_SAMPLES, LINES, LISTING, query
from millrace.session import stage
from millrace.sources.synth import fill_batches, rows_of, stalled_samples, uniform_samples

FILL_ROWS, FILL_LEN = 4, 15
SYNTH = FeedConfig(seq_len=16)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda total, v: total + v)


def place_sum(x: Column) -> Column:
    """Sum of 1-based place times value, which changes when values change places."""
    placed = F.transform(x, lambda v, i: v * (i + 1))
    return array_sum(placed)


def r6(column: Column) -> Column:
    return F.round(column, 6)


@query(
    "doc_shard_manifest",
    f"WITH {DOC_SAMPLES} SELECT sample_id // 64 AS shard_id, count(*) AS n_samples, "
    "sum(n_tokens)::BIGINT AS n_tokens, (count(*) * 8200)::BIGINT AS n_bytes, sum(y)::BIGINT AS n_pos "
    "FROM samples GROUP BY 1",
)
def doc_shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(inputs.doc_shards(spark, sf_dir), F.col("n_tokens"))


@query(
    "shard_names",
    f"WITH {LISTING} SELECT file_no, name, "
    "try_cast(nullif(regexp_extract(name, 'shard_([0-9]+)\\.pt', 1), '') AS BIGINT) AS shard_id, "
    "regexp_matches(name, '^shard_[0-9]+\\.pt$') AS publishable FROM listing",
)
def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return inputs.listing(spark, sf_dir).select(
        "file_no",
        "name",
        shard_index(name).alias("shard_id"),
        is_publishable(name).alias("publishable"),
    )


@query(
    "leftovers",
    f"WITH {LISTING} SELECT file_no, name, name = 'DONE' OR (starts_with(name, 'shard_') AND "
    "(name LIKE '%.pt' OR name LIKE '%.pt.tmp')) AS strict, "
    "name = 'DONE' OR starts_with(name, 'shard_') AS loose FROM listing",
)
def leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return inputs.listing(spark, sf_dir).select(
        "file_no",
        "name",
        is_leftover(name).alias("strict"),
        is_leftover(name, strict=False).alias("loose"),
    )


@query(
    "valid_batches",
    f"WITH {LINES} SELECT shard_id, n, sample_size, n * sample_size AS bytes FROM batches "
    "WHERE n * sample_size > 0 AND n * sample_size < 2097152",
)
def valid_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("n"), F.col("sample_size")
    accepted, _ = split_valid(inputs.line_batches(spark, sf_dir), n, size)
    return accepted.withColumn("bytes", batch_bytes(n, size))


@query(
    "rejected_batches",
    f"WITH {LINES} SELECT shard_id, n, sample_size, "
    "CASE WHEN n * sample_size <= 0 THEN 'empty' ELSE 'over cap' END AS reason FROM batches "
    "WHERE n * sample_size <= 0 OR n * sample_size >= 2097152",
)
def rejected_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_valid(inputs.line_batches(spark, sf_dir), F.col("n"), F.col("sample_size"))[1]


@query(
    "clamp_tokens",
    "SELECT o_orderkey, ((w % 10000) + 10000) % 10000 AS t0, ((-w % 10000) + 10000) % 10000 AS t1, "
    "((w * 3 + o_custkey) % 10000 + 10000) % 10000 AS t2 "
    "FROM (SELECT *, o_orderkey * 7919 - 50000000 AS w FROM orders)",
)
def clamp_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    x = clamp_tokens(F.array(w, -w, w * 3 + F.col("o_custkey")))
    clamped = inputs.order_words(spark, sf_dir).select("o_orderkey", x.alias("x"))
    return clamped.select("o_orderkey", *[F.get("x", F.lit(i)).alias(f"t{i}") for i in range(3)])


@query(
    "clamp_labels",
    "SELECT o_orderkey, ((w % 2) + 2) % 2 AS label "
    "FROM (SELECT o_orderkey, o_orderkey * 7919 - 50000000 AS w FROM orders)",
)
def clamp_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = inputs.order_words(spark, sf_dir)
    return words.select("o_orderkey", clamp_labels(F.col("word")).alias("label"))


@query(
    "doc_tokens",
    """WITH w AS (
      SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda v: v <> '') AS ws
      FROM documents),
    t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
    s AS (
      SELECT doc_id, sum(tok)::BIGINT AS token_sum, sum(tok * (pos + 1))::BIGINT AS place_sum
      FROM (SELECT *, ('0x' || substr(md5(word), 1, 8))::BIGINT % 10000 AS tok FROM t) GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_tokens, coalesce(token_sum, 0) AS token_sum,
           coalesce(place_sum, 0) AS place_sum
    FROM w LEFT JOIN s ON s.doc_id = w.doc_id""",
)
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = inputs.documents(spark, sf_dir).select("doc_id", token_ids(F.col("text")).alias("x"))
    return tokens.select(
        "doc_id",
        F.size("x").cast("bigint").alias("n_tokens"),
        array_sum(F.col("x")).alias("token_sum"),
        place_sum(F.col("x")).alias("place_sum"),
    )


@query(
    "pad_or_cut",
    f"WITH {ALL_SAMPLES}, t AS (SELECT sample_id, sum(token)::BIGINT AS token_sum, "
    "sum(token * (pos + 1))::BIGINT AS place_sum FROM tokens GROUP BY 1) "
    "SELECT doc_id, part, 1024::BIGINT AS row_len, n_tokens, coalesce(token_sum, 0) AS token_sum, "
    "coalesce(place_sum, 0) AS place_sum FROM samples s LEFT JOIN t ON t.sample_id = s.sample_id",
)
def pad_or_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.doc_rows(spark, sf_dir, labelled=False).select(
        "doc_id",
        "part",
        F.size("x").cast("bigint").alias("row_len"),
        "n_tokens",
        array_sum(F.col("x")).alias("token_sum"),
        place_sum(F.col("x")).alias("place_sum"),
    )


@query(
    "sample_sizes",
    f"WITH {LINES} SELECT shard_id, 8 * (n + 1) AS sample_bytes, 64 * 8 * (n + 1) AS shard_bytes "
    "FROM batches",
)
def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = sample_bytes(F.col("n"))
    return inputs.line_batches(spark, sf_dir).select(
        "shard_id", size.alias("sample_bytes"), batch_bytes(F.lit(64), size).alias("shard_bytes")
    )


_HUMAN = "CASE {} ELSE printf('%6.1f TiB', b / 1099511627776.0::DOUBLE) END".format(
    " ".join(
        f"WHEN b < {1024 ** (p + 1)} THEN printf('%6.1f {u}', b / {1024**p}.0::DOUBLE)"
        for p, u in enumerate(("B", "KiB", "MiB", "GiB"))
    )
)


@query(
    "human_bytes",
    f"WITH {LINES} SELECT shard_id, {_HUMAN} AS size FROM "
    "(SELECT shard_id, n * sample_size * (shard_id * shard_id * shard_id + 1) AS b FROM batches)",
)
def human_bytes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Past 2**63 bytes in larger tables, so in whole decimals.
    s = F.col("shard_id").cast("decimal(20,0)")
    size = batch_bytes(F.col("n"), F.col("sample_size")) * (s * s * s + 1)
    return inputs.line_batches(spark, sf_dir).select("shard_id", human_bytes(size).alias("size"))


@query(
    "phase_ms",
    "SELECT event_id, round(greatest(0, value / 1000.0::DOUBLE - 0.1::DOUBLE) * 1000, 6) AS load_ms, "
    "round((value / 1000.0::DOUBLE + 0.1::DOUBLE) * 1000, 6) AS wait_ms FROM events",
)
def phase_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds, stall = F.col("value") / 1000.0, F.lit(0.1)
    return inputs.table(spark, sf_dir, "events").select(
        "event_id",
        r6(to_ms(load_time(seconds, stall))).alias("load_ms"),
        r6(to_ms(seconds + stall)).alias("wait_ms"),
    )


@query(
    "label_join",
    "SELECT d.doc_id, l.quality::BIGINT AS y, length(d.text) AS chars "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def label_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.labelled_documents(spark, sf_dir)
    return docs.select("doc_id", "y", F.length("text").cast("bigint").alias("chars"))


@query(
    "unlabelled",
    "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS "
    "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def unlabelled_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return unlabelled(docs, inputs.table(spark, sf_dir, "labels"), "doc_id")


@query(
    "assign_shards",
    f"WITH {LINES} SELECT sample_id // 1000 AS shard_id, count(*) AS n, min(l_orderkey) AS first_key, "
    "max(l_orderkey) AS last_key, sum(l_linenumber * (sample_id % 1000))::BIGINT AS place_sum "
    "FROM lines GROUP BY 1",
)
def assign_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.line_shards(spark, sf_dir).groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_orderkey").alias("first_key"),
        F.max("l_orderkey").alias("last_key"),
        F.sum(F.col("l_linenumber") * F.col("pos_in_shard")).alias("place_sum"),
    )


@query(
    "shard_order",
    f"WITH {LISTING}, s AS (SELECT name, regexp_extract(name, 'shard_([0-9]+)\\.pt', 1)::BIGINT AS shard_id "
    "FROM listing WHERE regexp_matches(name, '^shard_[0-9]+\\.pt$')) "
    "SELECT name, shard_id, row_number() OVER (ORDER BY shard_id) AS rank FROM s",
)
def shard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inputs.listing(spark, sf_dir).where(is_publishable(F.col("name")))
    named = files.select("name", shard_index(F.col("name")).alias("shard_id"))
    return order_shards(stage(named, "names"))


@query(
    "next_shard",
    f"WITH {ARRIVALS} SELECT stream, shard_id, ts_us, bytes FROM "
    "(SELECT *, row_number() OVER (PARTITION BY stream ORDER BY shard_id) AS rn FROM arrivals) WHERE rn = 1",
)
def next_shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = inputs.arrivals(spark, sf_dir).select("stream", "shard_id", "ts_us", "bytes")
    return next_shard(waiting, "stream")


_SHUFFLED = (
    LINES
    + """,
shuffled AS (
  SELECT sample_id, sample_id // 1000 AS shard_id,
         row_number() OVER (PARTITION BY sample_id // 1000 ORDER BY md5('7:' || sample_id), sample_id) AS rn
  FROM lines)"""
)


@query("shuffle_in_shard", f"WITH {_SHUFFLED} SELECT shard_id, sample_id, rn FROM shuffled")
def shuffle_in_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = inputs.line_shards(spark, sf_dir)
    return shuffle_within_shard(shards.select("shard_id", "sample_id"), 7)


@query(
    "minibatches",
    f"WITH {_SHUFFLED} SELECT shard_id, (rn - 1) // 64 AS minibatch, count(*) AS n, "
    "sum(sample_id)::BIGINT AS id_sum FROM shuffled GROUP BY 1, 2",
)
def minibatches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = inputs.line_shards(spark, sf_dir).select("shard_id", "sample_id")
    cut = minibatches(shuffle_within_shard(shards, 7), 64)
    return cut.groupBy("shard_id", "minibatch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("id_sum")
    )


@query(
    "pack_shards",
    f"WITH {DOC_SAMPLES}, t AS (SELECT sample_id // 64 AS shard_id, sum(token)::BIGINT AS token_sum "
    "FROM tokens GROUP BY 1), "
    "s AS (SELECT sample_id // 64 AS shard_id, count(*) AS rows, "
    "sum(y * (sample_id % 64 + 1))::BIGINT AS label_place_sum FROM samples GROUP BY 1) "
    "SELECT s.shard_id, rows, rows AS labels, coalesce(token_sum, 0) AS token_sum, label_place_sum "
    "FROM s LEFT JOIN t ON t.shard_id = s.shard_id",
)
def pack_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_shards(inputs.doc_shards(spark, sf_dir))
    return packed.select(
        "shard_id",
        F.size("x").cast("bigint").alias("rows"),
        F.size("y").cast("bigint").alias("labels"),
        array_sum(F.transform("x", array_sum)).alias("token_sum"),
        place_sum(F.col("y")).alias("label_place_sum"),
    )


SAMPLE_SUMS_SQL = (
    f"WITH {DOC_SAMPLES}, t AS (SELECT sample_id, sum(token)::BIGINT AS token_sum, "
    "sum(token * (pos + 1))::BIGINT AS place_sum FROM tokens GROUP BY 1) "
    "SELECT s.sample_id // 64 AS shard_id, s.sample_id % 64 AS pos_in_shard, y, "
    "coalesce(token_sum, 0) AS token_sum, coalesce(place_sum, 0) AS place_sum "
    "FROM samples s LEFT JOIN t ON t.sample_id = s.sample_id"
)


def sample_sums(samples: DataFrame) -> DataFrame:
    return samples.select(
        "shard_id",
        "pos_in_shard",
        "y",
        array_sum(F.col("x")).alias("token_sum"),
        place_sum(F.col("x")).alias("place_sum"),
    )


@query("unpack_shards", SAMPLE_SUMS_SQL)
def unpack_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_sums(unpack_shards(pack_shards(inputs.doc_shards(spark, sf_dir))))


def _draw_sql(seed: int, shard: str, pos: str, place: str, bound: int) -> str:
    text = f"'{seed}:' || {shard} || ':' || {pos} || ':' || {place}"
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT % {bound}"


def _synth_sql(seed: int) -> str:
    return f"""WITH {LINES}, slots AS (
      SELECT sample_id // 1000 AS shard_id, sample_id % 1000 AS pos FROM lines),
    drawn AS (
      SELECT shard_id, pos, i, {_draw_sql(seed, 'shard_id', 'pos', 'i', 10000)} AS token
      FROM slots, range(16) r(i)),
    labels_ AS (
      SELECT shard_id, sum({_draw_sql(seed, 'shard_id', 'pos', "'y'", 2)})::BIGINT AS n_pos
      FROM slots GROUP BY 1)
    SELECT d.shard_id, (count(*) // 16)::BIGINT AS n, sum(token)::BIGINT AS token_sum,
           sum(token * (i + 1) * (pos + 1))::BIGINT AS place_sum, any_value(n_pos) AS n_pos
    FROM drawn d JOIN labels_ l ON l.shard_id = d.shard_id GROUP BY 1"""


def _synth_sums(samples: DataFrame) -> DataFrame:
    return samples.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(array_sum(F.col("x"))).alias("token_sum"),
        F.sum(place_sum(F.col("x")) * (F.col("pos_in_shard") + 1)).alias("place_sum"),
        F.sum("y").alias("n_pos"),
    )


@query("synth_uniform", _synth_sql(3))
def synth_uniform_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = rows_of(inputs.line_batches(spark, sf_dir), "n")
    return _synth_sums(uniform_samples(slots, SYNTH, 3))


@query("stalled_content", _synth_sql(11))
def stalled_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = inputs.line_batches(spark, sf_dir).withColumnRenamed("n", "n_samples")
    return _synth_sums(stalled_samples(manifest, SYNTH, 11))


_FILL = (
    LINES
    + """,
fill AS (
  SELECT shard_id, CASE WHEN b >= 128 THEN (b * 72340172838076673 - 18446744073709551616)::BIGINT
                        ELSE (b * 72340172838076673)::BIGINT END AS word
  FROM (SELECT shard_id, (shard_id % 256)::HUGEINT AS b FROM batches))"""
)


@query(
    "synth_fill",
    f"WITH {_FILL} SELECT shard_id, word, {FILL_ROWS * (FILL_LEN + 1)}::BIGINT AS n_words, "
    f"{8 * FILL_ROWS * (FILL_LEN + 1)}::BIGINT AS length FROM fill",
)
def synth_fill_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = inputs.line_batches(spark, sf_dir).select("shard_id")
    return fill_batches(batches, FILL_ROWS, FILL_LEN).select(
        "shard_id",
        F.get("words", F.lit(0)).alias("word"),
        F.size("words").cast("bigint").alias("n_words"),
        "length",
    )


@query(
    "reshape_fill",
    f"WITH {_FILL} SELECT shard_id, r::BIGINT AS pos_in_shard, {FILL_LEN}::BIGINT AS row_len, "
    "((word % 10000) + 10000) % 10000 AS token, ((word % 2) + 2) % 2 AS y "
    f"FROM fill, range({FILL_ROWS}) t(r)",
)
def reshape_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = inputs.line_batches(spark, sf_dir).select("shard_id")
    raw = fill_batches(batches, FILL_ROWS, FILL_LEN)
    shaped = raw.select(
        "shard_id", reshape_words(F.col("words"), F.lit(FILL_ROWS), FILL_LEN).alias("s")
    )
    rows = unpack_shards(shaped.select("shard_id", "s.x", "s.y"))
    return rows.select(
        "shard_id",
        "pos_in_shard",
        F.size("x").cast("bigint").alias("row_len"),
        F.get(clamp_tokens(F.col("x")), F.lit(FILL_LEN - 1)).alias("token"),
        clamp_labels(F.col("y")).alias("y"),
    )

"""Pairings of logs, manifests, labels and vectors. All are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.session import BROADCAST_BYTES, fresh_dir, stage

# A key is hot if it holds more than one in so many rows; so there are at most as many hot keys.
HOT_SHARE = 2000


def cross_check(published: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Publish log against shard log: which side knows each shard, and gap less measured wait.

    ``published`` carries ``gap_us``, ``consumed`` carries ``wait_us``; shards are unique in both.
    """
    left = published.select(*keys, "gap_us", F.lit(True).alias("_published"))
    right = consumed.select(*keys, "wait_us", F.lit(True).alias("_consumed"))
    status = (
        F.when(F.col("_consumed").isNull(), F.lit("published only"))
        .when(F.col("_published").isNull(), F.lit("consumed only"))
        .otherwise(F.lit("both"))
    )
    return left.join(right, keys, "full_outer").select(
        *keys,
        status.alias("status"),
        "gap_us",
        "wait_us",
        (F.col("gap_us") - F.col("wait_us")).alias("gap_less_wait_us"),
    )


def pending_shards(published: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Published and not consumed yet."""
    return published.join(consumed.select(*keys), keys, "left_anti")


def shape_check(manifest: DataFrame, config: FeedConfig) -> DataFrame:
    """Shards whose shape differs from what the reader expects, with the reason.

    ``manifest`` has ``n_samples``, ``n_bytes`` and ``seq_len``. The expected shape is a handful of
    constants, so nothing is joined. The last shard of a table may be short; the manifest is stored, for its last number
    has to be known before its rows are judged.
    """
    manifest = stage(manifest, "manifest")
    last = manifest.agg(F.max("shard_id")).first()[0]
    short_last = (F.col("shard_id") == last) & (F.col("n_samples") < config.batch_size)
    expected_bytes = F.col("n_samples") * (F.col("seq_len").cast("bigint") + 1) * 8
    fault = (
        F.when(F.col("seq_len") != config.seq_len, F.lit("row length"))
        .when((F.col("n_samples") != config.batch_size) & ~short_last, F.lit("samples"))
        .when(F.col("n_bytes") != expected_bytes, F.lit("bytes"))
        .when(F.col("n_bytes") >= config.cap_bytes, F.lit("over cap"))
    )
    return manifest.withColumn("fault", fault).where(F.col("fault").isNotNull())


def label_join(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Each sample with its label. The join kind is left to the optimizer, which sees both sizes."""
    return samples.join(labels, key)


def unlabelled(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return samples.join(labels.select(key), key, "left_anti")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the optimizer's size of ``df`` is at most ``limit``; otherwise ``df`` as it is,
    so that a sort-merge join with skew handling takes over."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """The keys of ``counts`` (one row a key, ``n`` its rows) that hold more than one in ``share`` of all rows: ``share`` at most."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.where(F.col(n) > max(1, total // share)).select(key)


def join_apart(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join with ``table``, which has one row a key, where a few keys may hold most of ``rows``.

    ``hot`` has the few keys (``hot_keys``). Their rows of ``table`` are broadcast, so rows of hot keys are not shuffled; all
    others are joined by shuffle. ``table`` is read once for either. Rows with a null key match nothing: an inner join drops
    them, a left one keeps them in place.
    """
    few = F.broadcast(hot.select(F.col(key).alias("_hot_key")))
    is_hot = F.col(key) == F.col("_hot_key")
    known = rows.where(F.col(key).isNotNull())
    out = known.join(few, is_hot, "left_semi").join(F.broadcast(table.join(few, is_hot, "left_semi")), key, how).unionByName(
        known.join(few, is_hot, "left_anti").join(table, key, how)
    )
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out.select(*rows.columns, *[c for c in table.columns if c != key])


def bucketed_vectors(table: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """``table(token, vec)`` stored as table ``name`` in buckets by token, so that lookups shuffle the tokens alone.

    The vectors are shuffled once, here. ``buckets`` should be no fewer than the session's shuffle partitions, or Spark may shuffle
    them again. An existing table of that name is replaced.
    """
    spark = table.sparkSession
    rows = table.repartition(buckets, "token")
    rows.write.mode("overwrite").option("path", path or fresh_dir(spark, "vectors")).bucketBy(buckets, "token").sortBy("token").saveAsTable(name)
    return spark.table(name)


def embedding_lookup(tokens: DataFrame, table: DataFrame, dim: int, pad: int = 0) -> DataFrame:
    """Vector of each token: ``vec`` of ``table(token, vec)``, zeros for padding, unknown and null tokens.

    A small table is broadcast. Of a large one, which is best in buckets (``bucketed_vectors``), no row is copied: tokens are counted,
    one row per token and task being shuffled; those of a large share keep their places and meet their broadcast vectors, at most
    ``HOT_SHARE`` and ``BROADCAST_BYTES`` of them; the others are joined by shuffle or bucket. ``tokens`` is read three times then.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    vectors = table.where(F.col("token") != pad).select("token", "vec")
    small = broadcast_if_small(vectors)
    if small is not vectors:
        joined = tokens.join(small, "token", "left")
    else:
        counts = stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
        share = max(1, min(HOT_SHARE, BROADCAST_BYTES // (4 * dim + 64)))
        hot = stage(hot_keys(counts.where(F.col("token").isNotNull()), "token", share=share), "hot-tokens")
        joined = join_apart(tokens, vectors, "token", hot, "left")
    return joined.select(*tokens.columns, F.coalesce("vec", zeros).alias("vec"))

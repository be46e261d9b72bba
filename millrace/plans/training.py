"""Queries over vectors, scores, gradients and training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import FeedConfig
from millrace.operators import model
from millrace.operators.joins import embedding_lookup
from millrace.plans import inputs
from millrace.plans.inputs import CONFIG, fixed_weights
from millrace.plans.registry import ALL_SAMPLES, DOC_SAMPLES, query, weight_sql
from millrace.plans.shaping import r6
from millrace.session import fresh_dir
from millrace.sinks.store import create_store, publish
from millrace.sources.store import read_store

DIM = 64
TRAIN = FeedConfig(batch_size=256)
# Files small enough that a step reads little else than its shards.
TRAIN_FILE_BYTES = 64 * 1024 * 1024


def weights(spark: SparkSession) -> DataFrame:
    """A fixed set of weights: one row per token id and one for the bias."""
    weight = fixed_weights(CONFIG.vocab)
    token = F.when(F.col("id") == 0, F.lit(model.BIAS)).otherwise(F.col("id"))
    ids = spark.range(CONFIG.vocab).select(token.alias("token"))
    return ids.select("token", F.array(weight(F.col("token"), 0), weight(F.col("token"), 1)).alias("w"))


def samples(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    return inputs.doc_shards(spark, sf_dir, labelled=labelled).select("shard_id", "sample_id", "x", "y")


@query(
    "embedding_lookup",
    f"""WITH {ALL_SAMPLES}, vecs AS (
      SELECT vec_id, unnest(range({DIM})) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
    hits AS (
      SELECT CASE WHEN token = 0 THEN -1 ELSE token % (SELECT count(*) FROM embeddings) END AS vec_id,
             count(*) AS times FROM tokens GROUP BY 1)
    SELECT dim, sum(times * floor(v * 1000000)::BIGINT)::BIGINT AS micro_sum, count(DISTINCT vec_id) AS vectors
    FROM hits JOIN vecs USING (vec_id) WHERE vec_id > 0 GROUP BY dim""",
)
def embedding_lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the vectors of all tokens, per dimension, in millionths so that it is exact.

    Equal tokens are counted first, so that vectors are unfolded once per distinct token.
    """
    table = inputs.embedding_table(spark, sf_dir)
    count = table.count()
    # Padding and id 0 both look up the zero vector, and so does an id that maps to vector 0.
    ids = samples(spark, sf_dir, labelled=False).select(F.explode("x").alias("id"))
    tokens = ids.groupBy((F.col("id") % count).alias("token")).agg(F.count(F.lit(1)).alias("times"))
    looked = embedding_lookup(tokens, table, DIM).where(F.col("token") != 0)
    micro = F.transform("vec", lambda v: F.floor(v.cast("double") * 1000000).cast("bigint"))
    rows = looked.select("token", "times", F.posexplode(micro).alias("dim", "m"))
    return rows.groupBy(F.col("dim").cast("bigint").alias("dim")).agg(
        F.sum(F.col("m") * F.col("times")).alias("micro_sum"),
        F.count(F.lit(1)).alias("vectors"),
    )


_SCORES = f""",
scored AS (
  SELECT s.sample_id, s.y, coalesce(z0, 0) + {weight_sql("'-1'", 0)} AS z0,
         coalesce(z1, 0) + {weight_sql("'-1'", 1)} AS z1
  FROM samples s LEFT JOIN (
    SELECT sample_id, sum({weight_sql("token", 0)}) AS z0, sum({weight_sql("token", 1)}) AS z1
    FROM tokens WHERE token <> 0 GROUP BY 1) t ON t.sample_id = s.sample_id)"""
_SCORED, _ALL_SCORED = DOC_SAMPLES + _SCORES, ALL_SAMPLES + _SCORES


def scored(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    return model.score(samples(spark, sf_dir, labelled), weights(spark), CONFIG)


@query("score", f"WITH {_ALL_SCORED} SELECT sample_id, y, z0, z1 FROM scored")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = [F.get("logits", F.lit(k)).alias(f"z{k}") for k in range(2)]
    return scored(spark, sf_dir, labelled=False).select("sample_id", "y", *logits)


@query(
    "cross_entropy",
    f"WITH {_SCORED} SELECT sample_id, round(greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + "
    "exp(z1 - greatest(z0, z1))) - CASE WHEN y = 1 THEN z1 ELSE z0 END, 6) AS loss FROM scored",
)
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = model.cross_entropy(F.col("logits"), F.col("y"))
    return scored(spark, sf_dir).select("sample_id", r6(loss).alias("loss"))


@query(
    "predict",
    f"WITH {_ALL_SCORED} SELECT sample_id, CASE WHEN z1 > z0 THEN 1 ELSE 0 END::BIGINT AS class FROM scored",
)
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, labelled=False).select("sample_id", model.predict(F.col("logits")).alias("class"))


@query(
    "shard_scores",
    f"WITH {_SCORED}, l AS (SELECT *, greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + "
    "exp(z1 - greatest(z0, z1))) - CASE WHEN y = 1 THEN z1 ELSE z0 END AS loss FROM scored) "
    "SELECT sample_id // 64 AS shard_id, count(*) AS n, round(sum(loss) / count(*), 6) AS loss, "
    "sum(CASE WHEN (z1 > z0) = (y = 1) THEN 1 ELSE 0 END)::BIGINT AS correct FROM l GROUP BY 1",
)
def shard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = scored(spark, sf_dir).withColumn("shard_id", F.call_function("div", F.col("sample_id"), F.lit(64)))
    by_shard = model.batch_metrics(shards, ["shard_id"])
    return by_shard.select("shard_id", "n", r6(F.col("loss")).alias("loss"), "correct")


_GRADIENT = (
    DOC_SAMPLES
    + """,
pulls AS (
  SELECT token, CASE WHEN y = 0 THEN -0.5 ELSE 0.5 END::DOUBLE AS e0,
         CASE WHEN y = 1 THEN -0.5 ELSE 0.5 END::DOUBLE AS e1 FROM tokens WHERE token <> 0
  UNION ALL
  SELECT -1, CASE WHEN y = 0 THEN -0.5 ELSE 0.5 END::DOUBLE,
         CASE WHEN y = 1 THEN -0.5 ELSE 0.5 END::DOUBLE FROM samples),
grads AS (
  SELECT token, sum(e0) / (SELECT count(*) FROM samples) AS g0, sum(e1) / (SELECT count(*) FROM samples) AS g1
  FROM pulls GROUP BY token)"""
)


def first_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.gradient(model.score(samples(spark, sf_dir), model.zero_state(spark), CONFIG, "x"), CONFIG)


@query(
    "train_step_gradient",
    f"WITH {_GRADIENT} SELECT token, round(g0, 6) AS g0, round(g1, 6) AS g1 FROM grads",
)
def train_step_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the whole table as one minibatch at zero weights."""
    g = first_gradient(spark, sf_dir)
    return g.select("token", *[r6(F.get("g", F.lit(k))).alias(f"g{k}") for k in range(2)])


def _adam_sql(g: str) -> str:
    return f"round(-0.001::DOUBLE * {g} / (sqrt({g} * {g}) + 1e-8), 6)"


@query(
    "train_step_update",
    f"WITH {_GRADIENT} SELECT token, {_adam_sql('g0')} AS w0, {_adam_sql('g1')} AS w1 FROM grads",
)
def train_step_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after the first optimizer step."""
    state = model.adam_step(model.zero_state(spark), first_gradient(spark, sf_dir), 1, CONFIG)
    return state.select("token", *[r6(F.get("w", F.lit(k))).alias(f"w{k}") for k in range(2)])


# One optimizer step per shard of 256 samples, each from the state that the one before it left. A row of the state is
# (token, w, m, v); tokens -2 and -3 carry the metrics that were taken before the step.
TRAINED = f"""WITH RECURSIVE {DOC_SAMPLES},
counts AS MATERIALIZED (
  SELECT sample_id // 256 AS shard, sample_id, token, count(*)::DOUBLE AS c FROM tokens WHERE token <> 0 GROUP BY ALL
  UNION ALL SELECT sample_id // 256, sample_id, -1, 1.0 FROM samples),
labels_of AS MATERIALIZED (SELECT sample_id // 256 AS shard, sample_id, y FROM samples),
steps AS (
  SELECT 0::BIGINT AS step, token, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1
  FROM (SELECT DISTINCT token FROM counts)
  UNION ALL
  SELECT * FROM (
    WITH now AS MATERIALIZED (SELECT * FROM steps),
    z AS MATERIALIZED (
      SELECT sample_id, y, sum(c * w0) AS z0, sum(c * w1) AS z1
      FROM labels_of JOIN counts USING (shard, sample_id) JOIN now USING (token)
      WHERE shard = now.step AND now.token >= -1 GROUP BY ALL),
    p AS MATERIALIZED (SELECT *, greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS whole FROM z),
    e AS MATERIALIZED (SELECT sample_id, exp(z0 - whole) - (y = 0)::INT AS e0, exp(z1 - whole) - (y = 1)::INT AS e1 FROM p),
    g AS (
      SELECT token, sum(c * e0) / (SELECT count(*) FROM e) AS g0, sum(c * e1) / (SELECT count(*) FROM e) AS g1
      FROM e JOIN counts USING (sample_id) GROUP BY token),
    mv AS (
      SELECT step + 1 AS step, token, w0, w1, m0 * 0.9 + coalesce(g0, 0) * (1 - 0.9) AS m0, m1 * 0.9 + coalesce(g1, 0) * (1 - 0.9) AS m1,
             v0 * 0.999 + coalesce(g0 * g0, 0) * (1 - 0.999) AS v0, v1 * 0.999 + coalesce(g1 * g1, 0) * (1 - 0.999) AS v1
      FROM now LEFT JOIN g USING (token) WHERE token >= -1)
    SELECT step, token, w0 - (m0 / (1 - 0.9::DOUBLE ** step)) / (sqrt(v0 / (1 - 0.999::DOUBLE ** step)) + 1e-8) * 0.001,
           w1 - (m1 / (1 - 0.9::DOUBLE ** step)) / (sqrt(v1 / (1 - 0.999::DOUBLE ** step)) + 1e-8) * 0.001, m0, m1, v0, v1
    FROM mv WHERE (SELECT count(*) FROM e) > 0
    UNION ALL
    SELECT (SELECT max(step) FROM now) + 1, -2, count(*)::DOUBLE, sum(CASE WHEN (z1 > z0) = (y = 1) THEN 1 ELSE 0 END)::DOUBLE,
           sum(whole - CASE WHEN y = 1 THEN z1 ELSE z0 END), 0, 0, 0
    FROM p HAVING count(*) > 0))
SELECT step - 1 AS shard_id, w0::BIGINT AS n, (w0 * 8200)::BIGINT AS bytes, round(m0 / w0, 6) AS loss, w1::BIGINT AS correct, round(w1 / w0, 6) AS acc
FROM steps WHERE token = -2"""


@query("train_over_shards", TRAINED)
def train_over_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the document shards in order: the shard log."""
    log, _ = _trained(spark, sf_dir, 1)
    return log


@query(
    "train_several_shards",
    f"WITH {DOC_SAMPLES} SELECT sample_id // 256 AS shard_id, count(*) AS n, (count(*) * 8200)::BIGINT AS bytes, sample_id // 1024 AS step FROM samples "
    "GROUP BY ALL",
)
def train_several_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with four shards a step."""
    _, raw = _trained(spark, sf_dir, 4)
    return raw.select("shard_id", "n", "bytes", F.col("batch_id").alias("step"))


def _trained(spark: SparkSession, sf_dir: str, shards_per_step: int) -> tuple[DataFrame, DataFrame]:
    """(rounded log, log) of training on stored shards, so that each step reads the files of its shards only."""
    path = create_store(spark, fresh_dir(spark, "train-shards"))
    publish(inputs.doc_shards(spark, sf_dir, TRAIN), path, file_bytes=TRAIN_FILE_BYTES)
    log, _ = model.train_over_shards(
        read_store(spark, path), TRAIN, fresh_dir(spark, "training"), shards_per_step=shards_per_step,
        span=lambda low, high: read_store(spark, path, low, high),
    )
    return log.select(
        "shard_id", "n", "bytes", r6(F.col("loss")).alias("loss"), "correct", r6(F.col("acc")).alias("acc")
    ), log


@query("fit_classifier")
def fit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-table fit; loss and accuracy on the rows it was fitted to."""
    from pyspark.ml.functions import vector_to_array

    _, predictions = model.fit_classifier(samples(spark, sf_dir), CONFIG)
    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    return predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(-F.avg(F.log(F.greatest(p, F.lit(1e-15)))), 4).alias("loss"),
        F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 4).alias("acc"),
    )

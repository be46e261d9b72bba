"""A linear classifier trained shard by shard with Adam, as joins and grouped sums.

The state is a table ``token, w, m, v`` with one value per class in each array; token ``BIAS`` holds the
bias. It has a row for every token seen so far, so at most ``vocab + 1`` rows. Its size is checked before
it is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.config import LEARNING_RATE, WORD_BYTES, FeedConfig
from millrace.files import qualified
from millrace.operators.batching import minibatches, shuffle_within_shard
from millrace.schemas import MODEL_STATE, SHARD_LOG
from millrace.session import BROADCAST_BYTES, file_store, stage
from millrace.sinks.log import append_log, append_rows, read_log

BIAS = -1
# Fixed values of the optimizer.
BETA1 = 0.9
BETA2 = 0.999
EPSILON = 1e-8


def zero_state(spark: SparkSession) -> DataFrame:
    """State before the first step: nothing seen, all weights zero."""
    return spark.createDataFrame([], MODEL_STATE)


def sparse_rows(samples: DataFrame, config: FeedConfig, *keep: str) -> DataFrame:
    """The columns to ``keep`` and ``counts``: the distinct tokens of ``x``, ascending, each with how often it occurs.

    Ids are clamped to the vocabulary, which bounds the state to ``vocab + 1`` rows. Padding and null ids are left out, so a row
    of nothing else, or a null one, has no entries. All of it is array work inside the row.
    """
    real = F.filter(
        F.transform(F.coalesce("x", F.array().cast("array<bigint>")), lambda t: F.pmod(t, F.lit(config.vocab).cast("bigint"))),
        lambda t: t != config.pad,
    )
    ids = samples.select(*keep, F.array_sort(real).alias("_ids"))
    size = F.size("_ids")
    # A run of equal ids begins where an id differs from the one before it, and ends where the next run begins.
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("_ids", 1, F.greatest(size - 1, F.lit(0))))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(
        F.arrays_zip(F.col("_ids").alias("token"), before.alias("before"), places.alias("at")),
        lambda e: ~e["token"].eqNullSafe(e["before"]) & e["token"].isNotNull(),
    )
    runs = ids.select(*keep, begins.alias("_begins"), size.alias("_size"))
    ends = F.concat(F.slice(F.col("_begins.at"), 2, F.greatest(F.size("_begins"), F.lit(1))), F.array("_size"))
    entries = F.zip_with(
        "_begins", ends, lambda run, end: F.when(run.isNotNull(), F.struct(run["token"].alias("token"), (end - run["at"]).alias("n")))
    )
    return runs.select(*keep, F.filter(entries, lambda e: e.isNotNull()).alias("counts"))


def fits_one_job(config: FeedConfig) -> bool:
    """Whether a state of all possible tokens may be broadcast, or sent along with a step."""
    return (config.vocab + 1) * (3 * 8 * config.classes + 64) <= BROADCAST_BYTES


def _dense_weights(state: DataFrame, config: FeedConfig) -> Column:
    """All weights as one struct, an array a class: ``w0`` and so on, with token t at t, zero for padding, and the bias as ``b0`` and so on.

    It is an uncorrelated scalar subquery, the plan's only look at ``state``, and of at most ``vocab + 1`` rows, whose size
    ``fits_one_job`` has checked.
    """
    # One partition, of a size that has been checked, so nothing is exchanged to gather it.
    every = state.sparkSession.range(BIAS, config.vocab, 1, 1).select(F.col("id").alias("token"))
    known = state.where(F.col("token") != config.pad).select("token", "w")
    held = every.join(F.broadcast(known), "token", "left").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("_held"))
    tokens = F.slice("_held", 2, config.vocab)
    each = [F.transform(tokens, _weight_of(k)).alias(f"w{k}") for k in range(config.classes)]
    bias = [_weight_of(k)(F.get("_held", F.lit(0))).alias(f"b{k}") for k in range(config.classes)]
    return held.select(F.struct(*each, *bias)).scalar()


def _weight_of(k: int) -> Callable[[Column], Column]:
    return lambda entry: F.coalesce(F.get(entry["w"], F.lit(k)), F.lit(0.0))


def score(samples: DataFrame, state: DataFrame, config: FeedConfig, *keep: str) -> DataFrame:
    """``sample_id, y, logits`` for every sample and the columns to ``keep``; padding adds nothing, the bias adds once.

    Where the state fits, a sample's logits are sums over its own array of ids, each looked up in arrays of weights: a projection,
    nothing is exploded, joined or shuffled. Otherwise the distinct tokens of each sample are joined with the state and summed again,
    one row per sample and task being shuffled. Null ids, and a null ``x``, add nothing.
    """
    carried = ["sample_id", "y", *keep]
    classes = range(config.classes)
    if fits_one_job(config):
        dense = _dense_weights(state, config)
        # Each part of the weights is referred to once, so the optimizer puts the subquery's value in its place and no row
        # carries a copy of them.
        parts = [dense[f"{part}{k}"].alias(f"_{part}{k}") for part in "wb" for k in classes]
        held = samples.select("x", *[c for c in carried if c != "x"], *parts)

        return held.select(*carried, F.array(*[_row_sum(k, config) + F.col(f"_b{k}") for k in classes]).alias("logits"))
    weights = state.where(F.col("token") != config.pad).select("token", "w")
    sums = [F.coalesce(F.sum(F.col("n") * F.get("w", F.lit(k))), F.lit(0.0)).alias(f"z{k}") for k in classes]
    entries = _entries(sparse_rows(samples, config, *carried), *carried)
    scored = entries.join(weights, "token", "left").groupBy(*carried).agg(*sums)
    return scored.select(*carried, F.array(*[F.col(f"z{k}") for k in classes]).alias("logits"))


def _row_sum(k: int, config: FeedConfig) -> Column:
    """Sum of the weights of class ``k`` over the ids of a row; padding is cut out before."""
    real = F.coalesce(F.array_remove("x", config.pad), F.array().cast("array<bigint>"))

    def weight(t: Column) -> Column:
        return F.coalesce(F.get(f"_w{k}", F.pmod(t, F.lit(config.vocab).cast("bigint")).cast("int")), F.lit(0.0))

    return F.aggregate(real, F.lit(0.0), lambda total, t: total + weight(t))


def _entries(rows: DataFrame, *keep: str) -> DataFrame:
    """``token, n`` of each sparse row and one entry for its bias, with the columns to ``keep``."""
    bias = F.array(F.struct(F.lit(BIAS).cast("bigint").alias("token"), F.lit(1).alias("n")))
    return rows.select(*keep, F.inline(F.concat(bias, "counts")))


def _log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(
        F.aggregate(logits, F.lit(0.0), lambda total, z: total + F.exp(z - top))
    )


def cross_entropy(logits: Column, y: Column) -> Column:
    """Loss of one sample. The largest logit is taken out first, so large logits do not overflow."""
    return _log_sum_exp(logits) - F.get(logits, y.cast("int"))


def probabilities(logits: Column) -> Column:
    whole = _log_sum_exp(logits)
    return F.transform(logits, lambda z: F.exp(z - whole))


def predict(logits: Column) -> Column:
    """Class of the largest logit, the lowest one among equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("bigint")


def batch_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mean loss, correct and accuracy of scored samples."""
    hit = F.when(predict(F.col("logits")) == F.col("y"), 1).otherwise(0)
    return (
        scored.groupBy(*(by or []))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(cross_entropy(F.col("logits"), F.col("y"))), F.lit(0.0)).alias("loss_sum"),
            F.coalesce(F.sum(hit), F.lit(0)).alias("correct"),
        )
        .withColumns(
            {
                "loss": F.col("loss_sum") / F.greatest(F.col("n"), F.lit(1)),
                "acc": F.col("correct") / F.greatest(F.col("n"), F.lit(1)),
            }
        )
    )


def gradient(scored: DataFrame, config: FeedConfig, n: int | None = None) -> DataFrame:
    """``token, g``: mean-loss gradient per token and class over the samples of a minibatch, scored with their ``x`` kept.

    Padding gets none. A sample's errors are in its row, so samples are neither joined nor shuffled; each sends on one entry per
    distinct token, and a frequent token is summed on the map side. ``n`` is the number of samples where the caller knows it
    already; else the sums, ``vocab + 1`` rows at most, are stored and that of the bias says it.
    """
    p = probabilities(F.col("logits"))
    error = {
        f"e{k}": F.get(p, F.lit(k)) - F.when(F.col("y") == k, 1.0).otherwise(0.0) for k in range(config.classes)
    }
    judged = scored.select("x", *[e.alias(name) for name, e in error.items()])
    pulls = _entries(sparse_rows(judged, config, *error), *error)
    sums = pulls.groupBy("token").agg(
        F.count(F.lit(1)).alias("samples"), *[F.sum(F.col("n") * F.col(f"e{k}")).alias(f"g{k}") for k in range(config.classes)]
    )
    if n is None:
        sums = stage(sums, "gradient-sums")
        bias = sums.where(F.col("token") == BIAS).first()
        n = bias["samples"] if bias else 1
    mean = F.array(*[F.col(f"g{k}") / F.lit(n) for k in range(config.classes)])
    return sums.select("token", mean.alias("g"))


def adam_step(
    state: DataFrame, grads: DataFrame, step: int, config: FeedConfig, rate: float = LEARNING_RATE
) -> DataFrame:
    """State after step number ``step`` (from 1). Tokens without a gradient move on by momentum."""
    zeros = F.array_repeat(F.lit(0.0), config.classes)
    old = state.join(grads, "token", "full_outer").select(
        "token", *[F.coalesce(c, zeros).alias(c) for c in ("w", "m", "v", "g")]
    )
    moved = old.select(
        "token",
        "w",
        F.zip_with("m", "g", lambda m, g: m * BETA1 + g * (1 - BETA1)).alias("m"),
        F.zip_with("v", "g", lambda v, g: v * BETA2 + g * g * (1 - BETA2)).alias("v"),
    )
    first, second = 1 - BETA1**step, 1 - BETA2**step
    change = F.zip_with(
        "m", "v", lambda m, v: (m / first) / (F.sqrt(v / second) + EPSILON) * rate
    )
    return moved.select("token", F.zip_with("w", change, lambda w, d: w - d).alias("w"), "m", "v")


def train_minibatch(
    samples: DataFrame, state: DataFrame, step: int, config: FeedConfig, state_path: str
) -> tuple[DataFrame, dict]:
    """One optimizer step: (new state, metrics taken before it).

    The new state is written to ``state_path`` and read back, so lineage does not grow with the steps
    and a lost executor costs a re-read.
    """
    scored = score(samples, state, config, "x").persist()
    metrics = batch_metrics(scored).first().asDict()
    if metrics["n"] == 0:
        scored.unpersist()
        return state, metrics
    grads = gradient(scored, config, metrics["n"])
    adam_step(state, grads, step, config).write.mode("overwrite").parquet(state_path)
    scored.unpersist()
    return state.sparkSession.read.schema(MODEL_STATE).parquet(state_path), metrics


def train_shard(
    shard: DataFrame,
    state: DataFrame,
    step: int,
    config: FeedConfig,
    state_path: str,
    minibatch: int | None = None,
    seed: int = 0,
) -> tuple[DataFrame, int, dict]:
    """One pass over a shard: (state, last step number, the shard's n, bytes, loss, correct and accuracy).

    The shard is shuffled and cut into minibatches, as many as its rows give; by default it is one. Every row is
    trained on, whatever size the shard has.
    """
    whole = minibatch is None
    cut = shard.withColumn("minibatch", F.lit(0)) if whole else minibatches(shuffle_within_shard(shard, seed), minibatch)
    row_bytes = WORD_BYTES * (F.size("x") + 1).cast("bigint")
    facts = cut.agg(
        (F.coalesce(F.max("minibatch"), F.lit(-1)) + 1).alias("parts"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")
    ).first()
    n, loss_sum, correct = 0, 0.0, 0
    for part in range(facts["parts"]):
        rows = cut if whole else cut.where(F.col("minibatch") == part)
        state, m = train_minibatch(rows, state, step + 1, config, f"{state_path}/part={part}")
        step += 1
        n, loss_sum, correct = n + m["n"], loss_sum + m["loss_sum"], correct + m["correct"]
    return state, step, {
        "n": n,
        "bytes": facts["bytes"],
        "loss": loss_sum / max(n, 1),
        "correct": correct,
        "acc": correct / max(n, 1),
    }


class Weights:
    """The whole state as arrays of (vocab + 1) rows, the last one the bias, and one column a class.

    Steps that take it to the tasks and bring one gradient back need its size to be bounded; ``fits_one_job`` says whether it is.
    """

    def __init__(self, config: FeedConfig) -> None:
        if not fits_one_job(config):
            raise ValueError("the state is too large for steps of one job")
        shape = (config.vocab + 1, config.classes)
        self.w, self.m, self.v = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.seen, self.step = np.zeros(shape[0], bool), 0

    def packed(self) -> bytes:
        return zlib.compress(np.int64(self.step).tobytes() + self.seen.tobytes() + np.stack([self.w, self.m, self.v]).tobytes(), 1)

    def unpack(self, content: bytes) -> Weights:
        raw, rows = zlib.decompress(content), len(self.seen)
        self.step = int(np.frombuffer(raw, np.int64, 1)[0])
        self.seen = np.frombuffer(raw, bool, rows, 8).copy()
        self.w, self.m, self.v = np.frombuffer(raw, np.float64, offset=8 + rows).reshape(3, *self.w.shape).copy()
        return self

    def descend(self, g: np.ndarray, touched: np.ndarray, rate: float = LEARNING_RATE) -> None:
        """The optimizer's next step with the mean gradient; rows without one move on by momentum."""
        self.step += 1
        self.seen |= touched
        self.m = self.m * BETA1 + g * (1 - BETA1)
        self.v = self.v * BETA2 + g * g * (1 - BETA2)
        first, second = 1 - BETA1**self.step, 1 - BETA2**self.step
        self.w = self.w - (self.m / first) / (np.sqrt(self.v / second) + EPSILON) * rate

    def table(self, spark: SparkSession) -> DataFrame:
        """The state as ``token, w, m, v``, a row for every token seen and one for the bias."""
        rows = np.flatnonzero(self.seen)
        tokens = np.where(rows == len(self.seen) - 1, BIAS, rows).tolist()
        held = [self.w[rows].tolist(), self.m[rows].tolist(), self.v[rows].tolist()]
        return spark.createDataFrame(list(zip(tokens, *held)), MODEL_STATE)


# Rows of the sums that are no tokens: samples and right ones, loss and bytes.
_COUNTS, _LOSSES = -2, -3
# So many tasks of a step may send their sums, at most vocab + 1 each, straight to the driver.
FEW_TASKS = 8


def step_sums(samples: DataFrame, state: Weights, config: FeedConfig) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(sum of the gradients, rows that have one, metrics of each shard) of ``shard_id, x, y``, in one job.

    A task reads each row once: logits, losses and errors never leave it, pads are dropped where they are, and what it sends on is
    one sum per token it has met. At most vocab + 1 sums and two rows a shard come back.
    """
    classes, rows = config.classes, config.vocab + 1
    wide = max(classes, 2)
    w = state.w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, touched = np.zeros((rows, classes)), np.zeros(rows, bool)
        facts: dict[int, np.ndarray] = {}
        for batch in batches:
            shard, sizes = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy().astype(np.int64)
            y = batch.column(2).fill_null(-1).to_numpy()
            n = len(y)
            token = np.mod(batch.column(1).flatten().to_numpy(), config.vocab)
            sample = np.repeat(np.arange(n), sizes)
            real = token != config.pad
            token, sample = token[real], sample[real]
            z = w[-1] + np.stack([np.bincount(sample, w[token, k], n) for k in range(classes)], axis=1)
            top = z.max(axis=1, keepdims=True)
            whole = top[:, 0] + np.log(np.exp(z - top).sum(axis=1))
            error = np.exp(z - whole[:, None])
            known = (y >= 0) & (y < classes)
            at = np.flatnonzero(known)
            loss = np.zeros(n)
            loss[at] = whole[at] - z[at, y[at]]
            error[at, y[at]] -= 1
            for k in range(classes):
                g[:-1, k] += np.bincount(token, error[sample, k], rows - 1)
            g[-1] += error.sum(axis=0)
            touched[token] = touched[-1] = True
            hit = known & (z.argmax(axis=1) == y)
            for of in np.unique(shard):
                here = shard == of
                facts.setdefault(int(of), np.zeros(4))
                facts[int(of)] += [here.sum(), hit[here].sum(), loss[here].sum(), WORD_BYTES * (sizes[here] + 1).sum()]
        if not facts:
            return
        at = np.flatnonzero(touched)
        tokens = [*np.where(at == rows - 1, BIAS, at).tolist(), *[k for _ in facts for k in (_COUNTS, _LOSSES)]]
        shards = [None] * len(at) + [s for s in facts for _ in range(2)]
        sums = np.zeros((len(tokens), wide))
        sums[: len(at), :classes] = g[at]
        sums[len(at) :, :2] = np.concatenate([f.reshape(2, 2) for f in facts.values()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int64()), pa.array(tokens, pa.int64()), *[pa.array(sums[:, k]) for k in range(wide)]],
            ["shard_id", "token", *[f"g{k}" for k in range(wide)]],
        )

    parts = samples.select("shard_id", "x", "y").mapInArrow(run, "shard_id bigint, token bigint, " + ", ".join(f"g{k} double" for k in range(wide)))
    # The sums of a few tasks are added up here; those of many are shuffled by token first.
    if parts.rdd.getNumPartitions() > FEW_TASKS:
        parts = parts.groupBy("shard_id", "token").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(wide)])
    found = parts.toArrow()
    shard, token = found["shard_id"].to_pylist(), found["token"].to_numpy()
    sums = np.stack([found[f"g{k}"].to_numpy() for k in range(wide)], axis=1)
    g, touched, metrics = np.zeros((rows, classes)), np.zeros(rows, bool), {}
    at = np.flatnonzero(token >= BIAS)
    np.add.at(g, token[at], sums[at, :classes])  # -1 is the last row
    touched[token[at]] = True
    for i in np.flatnonzero(token < BIAS):
        m = metrics.setdefault(shard[i], {"n": 0, "correct": 0, "loss_sum": 0.0, "bytes": 0})
        if token[i] == _COUNTS:
            m["n"], m["correct"] = m["n"] + int(sums[i, 0]), m["correct"] + int(sums[i, 1])
        else:
            m["loss_sum"], m["bytes"] = m["loss_sum"] + float(sums[i, 0]), m["bytes"] + int(sums[i, 1])
    return g, touched, [{"shard_id": s, **metrics[s]} for s in sorted(metrics)]


def train_step(samples: DataFrame, state: Weights, config: FeedConfig) -> list[dict]:
    """One optimizer step over all samples, which may be of several shards: the metrics of each shard, taken before it."""
    g, touched, metrics = step_sums(samples, state, config)
    n = sum(m["n"] for m in metrics)
    if n:
        state.descend(g / n, touched)
    return [
        {**m, "loss": m.pop("loss_sum") / max(m["n"], 1), "acc": m["correct"] / max(m["n"], 1)} for m in metrics
    ]


STEP_LOG = StructType([f for f in SHARD_LOG.fields if f.name not in ("run_id", "batch_id")]).add("state", "binary")


def log_step(spark: SparkSession, metrics: list[dict], state: Weights, path: str, run_id: str, batch_id: int) -> None:
    """The log rows of a step's shards and, with the first of them, the state after it; one file."""
    content = state.packed()
    rows = [{**{f: m[f] for f in STEP_LOG.fieldNames()[:-1]}, "state": content if k == 0 else None} for k, m in enumerate(metrics)]
    append_rows(spark, pa.Table.from_pylist(rows, to_arrow_schema(STEP_LOG)), path, run_id, batch_id)


def state_after(spark: SparkSession, path: str, run_id: str, batch_id: int, config: FeedConfig) -> Weights:
    """The state that a step has left; what it was before the first one where the step had no rows."""
    store, root = file_store(f"{qualified(spark, path)}/run_id={run_id}/batch_id={batch_id}")
    with store.open_input_file(f"{root}/rows.parquet") as opened:
        held = pq.read_table(opened, columns=["state"])["state"].drop_null()
    return Weights(config).unpack(held[0].as_py()) if len(held) else Weights(config)


def train_over_shards(
    shards: DataFrame,
    config: FeedConfig,
    run_dir: str,
    minibatch: int | None = None,
    seed: int = 0,
    run_id: str = "run",
    shards_per_step: int = 1,
    span: Callable[[int, int], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One pass over numbered shards in order: (shard log, final state).

    A step takes the next ``shards_per_step`` shards: one job brings their summed gradient, and the driver writes the log rows and the
    state. ``span``, if given, reads the shards from one number to another, both included, from just the files that hold them; without
    it a step looks at all of ``shards``. With ``minibatch``, or where the state is too large to be sent along, steps go through tables, one shard after another.
    """
    spark = shards.sparkSession
    span = span or (lambda low, high: shards.where(F.col("shard_id").between(low, high)))
    # Numbers alone: the driver takes them in order, as many as a step is to have.
    numbers = [r["shard_id"] for r in shards.select("shard_id").distinct().orderBy("shard_id").collect()]
    append_log(spark.createDataFrame([], SHARD_LOG).drop("run_id", "batch_id"), f"{run_dir}/log", run_id, -1)
    if minibatch is None and fits_one_job(config):
        held = Weights(config)
        for order, at in enumerate(range(0, len(numbers), shards_per_step)):
            mine = numbers[at : at + shards_per_step]
            metrics = train_step(span(mine[0], mine[-1]), held, config)
            log_step(spark, metrics, held, f"{run_dir}/log", run_id, order)
        state = held.table(spark)
    else:
        state, step = zero_state(spark), 0
        for order, shard_id in enumerate(numbers):
            state, step, m = train_shard(
                span(shard_id, shard_id), state, step, config, f"{run_dir}/state/shard={shard_id}", minibatch, seed
            )
            log_shard(spark, m, shard_id, f"{run_dir}/log", run_id, order)
    return read_log(spark, f"{run_dir}/log", SHARD_LOG).where(F.col("batch_id") >= 0), state


def log_shard(
    spark: SparkSession, metrics: dict, shard_id: int, path: str, run_id: str, batch_id: int
) -> None:
    fields = [f for f in SHARD_LOG.fieldNames() if f not in ("run_id", "batch_id")]
    row = {**metrics, "shard_id": shard_id}
    schema = StructType([SHARD_LOG[f] for f in fields])
    append_log(spark.createDataFrame([[row[f] for f in fields]], schema), path, run_id, batch_id)


def fit_classifier(samples: DataFrame, config: FeedConfig, iterations: int = 20):
    """Logistic regression over the token counts of a whole table: (fitted pipeline, scored samples)."""
    words = samples.select(
        "sample_id",
        F.col("y").cast("double").alias("label"),
        F.transform(F.filter("x", lambda t: t != config.pad), lambda t: t.cast("string")).alias("words"),
    )
    # The vocabulary is all ids there can be, so nothing has to be counted to build it.
    counts = CountVectorizerModel.from_vocabulary(
        [str(t) for t in range(config.vocab)], inputCol="words", outputCol="features"
    )
    pipeline = Pipeline(stages=[counts, LogisticRegression(maxIter=iterations, regParam=0.01)])
    fitted = pipeline.fit(words)
    return fitted, fitted.transform(words)

"""Queries over the feed's logs: metrics, timelines and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import PHASES, FeedConfig
from millrace.operators import joins, metrics, timeline
from millrace.plans import inputs
from millrace.plans.inputs import STREAM_ORDER
from millrace.plans.registry import (
    ARRIVALS,
    DOC_SAMPLES,
    HELD,
    PHASE_LOG,
    PHASE_SUMS,
    SERVED,
    SHARD_LOG,
    query,
)
from millrace.plans.shaping import r6
from millrace.session import stage
from millrace.sources.synth import with_stall

PHASE_MS = [f"{p}_ms" for p in PHASES]
LOOKAHEAD = 3
CAP = 524288
STEPS = """steps AS (
  SELECT d.source, (d.n_chars % 100) / 100.0::DOUBLE AS loss, d.doc_id % 7 + 1 AS n,
         l.toxic AS prediction, l.quality AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def rounded_phases() -> list:
    return [r6(F.col(c)).alias(c) for c in PHASE_MS]


ROUNDED_PHASES = ", ".join(f"round({c}, 6) AS {c}" for c in PHASE_MS)


# -- metrics ---------------------------------------------------------------------------------------

@query(
    "weighted_mean",
    f"WITH {STEPS} SELECT source, round(sum(loss * n) / greatest(sum(n), 1), 6) AS loss FROM steps GROUP BY 1",
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = inputs.step_metrics(spark, sf_dir)
    mean = metrics.weighted_mean(F.col("loss"), F.col("n"))
    return steps.groupBy("source").agg(r6(mean).alias("loss"))


@query(
    "accuracy",
    f"WITH {STEPS} SELECT source, round(sum(CASE WHEN prediction = y THEN 1 ELSE 0 END)::DOUBLE "
    "/ greatest(count(*), 1), 6) AS acc FROM steps GROUP BY 1",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = inputs.step_metrics(spark, sf_dir)
    return steps.groupBy("source").agg(
        r6(metrics.accuracy(F.col("prediction") == F.col("y"))).alias("acc")
    )


@query(
    "run_totals",
    f"WITH {SHARD_LOG} SELECT run, shards, samples, correct, round(loss_sum, 6) AS loss_sum, bytes, "
    f"{ROUNDED_PHASES} FROM totals",
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = metrics.run_totals(inputs.shard_log(spark, sf_dir), ["run"])
    return totals.withColumn("loss_sum", r6(F.col("loss_sum"))).withColumns(
        {c: r6(F.col(c)) for c in PHASE_MS}
    )


def totals_with_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per run with its wall time; both come out of one pass over the log."""
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1000.0
    return metrics.run_totals(inputs.shard_log(spark, sf_dir), ["run"], span.alias("wall_ms"))


@query(
    "utilization",
    f"WITH {SHARD_LOG} SELECT run, "
    "round(CASE WHEN wall_ms > 0 THEN train_ms / wall_ms ELSE 0 END, 6) AS busy_frac, "
    "round(CASE WHEN wall_ms > 0 THEN wait_ms / wall_ms ELSE 0 END, 6) AS stall_frac, "
    "round(CASE WHEN wall_ms > 0 THEN (load_ms + pin_ms + h2d_ms) / wall_ms ELSE 0 END, 6) AS io_frac "
    "FROM totals",
)
def utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = metrics.utilization(totals_with_wall(spark, sf_dir), F.col("wall_ms"))
    names = ["busy_frac", "stall_frac", "io_frac"]
    return shares.select("run", *[r6(F.col(c)).alias(c) for c in names])


@query(
    "phase_pivot",
    f"WITH {PHASE_LOG}, p AS (SELECT run, {PHASE_SUMS} FROM phase_log GROUP BY run) "
    f"SELECT run, {ROUNDED_PHASES}, round(load_ms + pin_ms + h2d_ms, 6) AS io_ms FROM p",
)
def phase_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.phase_columns(inputs.phase_log(spark, sf_dir), ["run"])
    io = F.col("load_ms") + F.col("pin_ms") + F.col("h2d_ms")
    return wide.select("run", *rounded_phases(), r6(io).alias("io_ms"))


@query(
    "phase_unpivot",
    f"WITH {PHASE_LOG}, k AS (SELECT DISTINCT run FROM phase_log), "
    "n AS (SELECT unnest(['wait', 'load', 'pin', 'h2d', 'train']) AS phase) "
    "SELECT k.run, n.phase, round(coalesce(sum(ms), 0), 6) AS ms FROM k CROSS JOIN n "
    "LEFT JOIN phase_log p ON p.run = k.run AND p.phase = n.phase GROUP BY 1, 2",
)
def phase_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.phase_columns(inputs.phase_log(spark, sf_dir), ["run"])
    return metrics.phase_rows(wide, ["run"]).withColumn("ms", r6(F.col("ms")))


@query(
    "throughput",
    f"WITH {SHARD_LOG} SELECT run, "
    "round(CASE WHEN wall_ms > 0 THEN samples * 1000.0::DOUBLE / wall_ms ELSE 0 END, 6) AS samples_per_s, "
    "round(CASE WHEN wall_ms > 0 THEN bytes * 1000.0::DOUBLE / wall_ms ELSE 0 END, 6) AS bytes_per_s "
    "FROM totals",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = metrics.throughput(totals_with_wall(spark, sf_dir), F.col("wall_ms"))
    return rated.select("run", *[r6(F.col(c)).alias(c) for c in ("samples_per_s", "bytes_per_s")])


@query(
    "final_loss_acc",
    f"WITH {SHARD_LOG} SELECT run, round(loss_sum / greatest(samples, 1), 6) AS final_loss, "
    "round(correct::DOUBLE / greatest(samples, 1), 6) AS final_acc FROM totals",
)
def final_loss_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = metrics.run_totals(inputs.shard_log(spark, sf_dir), ["run"])
    final = metrics.final_loss_acc(totals)
    return final.select("run", *[r6(F.col(c)).alias(c) for c in ("final_loss", "final_acc")])


def _distribution_sql(by: str) -> str:
    return f"""WITH {PHASE_LOG}, ranked AS (
      SELECT {by}, ms, row_number() OVER (PARTITION BY {by} ORDER BY ms) - 1 AS i,
             count(*) OVER (PARTITION BY {by}) AS n
      FROM phase_log)
    SELECT {by}, any_value(n) AS n, min(ms) AS min_ms, round(median(ms), 6) AS p50_ms,
           round(avg(ms), 6) AS mean_ms,
           max(CASE WHEN i = least(n - 1, floor(0.95::DOUBLE * n)::BIGINT) THEN ms END) AS p95_ms,
           max(ms) AS max_ms
    FROM ranked GROUP BY {by}"""


def _rounded_distribution(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in ("p50_ms", "mean_ms")})


@query("phase_distribution", _distribution_sql("run, phase"))
def phase_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.phase_log(spark, sf_dir)
    return _rounded_distribution(metrics.phase_distribution(log, ["run", "phase"]))


@query("phase_distribution_all", _distribution_sql("phase"))
def phase_distribution_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all runs together, so each of the five groups holds a fifth of the rows."""
    log = inputs.phase_log(spark, sf_dir)
    return _rounded_distribution(metrics.phase_distribution(log, ["phase"]))


@query(
    "rate_every_k",
    f"WITH {ARRIVALS}, placed AS (SELECT *, row_number() OVER w AS pos, "
    "coalesce(lag(ts_us) OVER w, 0) AS before_us FROM arrivals "
    "WINDOW w AS (PARTITION BY stream ORDER BY ts_us, event_id)), "
    "g AS (SELECT stream, (pos - 1) // 10 AS grp, count(*) AS batches, sum(bytes)::BIGINT AS bytes, "
    "min(before_us) AS from_us, max(ts_us) AS to_us FROM placed GROUP BY 1, 2) "
    "SELECT stream, grp, batches, bytes, from_us, to_us, "
    "round(bytes / 1e6 / ((to_us - from_us) / 1e6), 6) AS mb_per_s, "
    "round(batches / ((to_us - from_us) / 1e6), 6) AS batches_per_s FROM g WHERE batches = 10",
)
def rate_every_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.rate_every_k(inputs.arrivals(spark, sf_dir), "stream", STREAM_ORDER)
    return rates.withColumns({c: r6(F.col(c)) for c in ("mb_per_s", "batches_per_s")})


@query(
    "empty_run",
    "SELECT count(*) AS shards, coalesce(sum(event_id), 0)::BIGINT AS samples, 0.0::DOUBLE AS busy_frac, "
    "0.0::DOUBLE AS samples_per_s, 0.0::DOUBLE AS final_loss, 'no samples' AS status "
    "FROM events WHERE value < 0",
)
def empty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a run in which no phase took less than no time: there is none."""
    log = inputs.shard_log(spark, sf_dir)
    none = log.where(F.least(*PHASE_MS) < 0)
    return metrics.run_summary(none, F.lit(0.0)).select(
        "shards", "samples", "busy_frac", "samples_per_s", "final_loss", "status"
    )


@query(
    "empty_distribution",
    "WITH n AS (SELECT unnest(['wait', 'load', 'pin', 'h2d', 'train']) AS phase), "
    "e AS (SELECT value FROM events WHERE value < 0) "
    "SELECT phase, count(e.value) AS n, quantile_disc(e.value, 0.95)::DOUBLE AS p95_ms FROM n LEFT JOIN e ON true GROUP BY phase",
)
def empty_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = inputs.phase_log(spark, sf_dir).where(F.col("ms") < 0)
    phases = metrics.all_phases(metrics.phase_distribution(none, ["phase"]))
    return phases.select("phase", "n", "p95_ms")


@query(
    "run_summary",
    f"WITH {SHARD_LOG}, s AS (SELECT sum(shards)::BIGINT AS shards, sum(samples)::BIGINT AS samples, "
    "sum(correct) AS correct, sum(loss_sum) AS loss_sum, sum(bytes)::BIGINT AS bytes, "
    "sum(train_ms) AS train_ms, sum(wait_ms) AS wait_ms FROM totals) "
    "SELECT shards, samples, bytes, round(train_ms / 2592000000.0::DOUBLE, 6) AS busy_frac, "
    "round(wait_ms / 2592000000.0::DOUBLE, 6) AS stall_frac, "
    "round(samples * 1000.0::DOUBLE / 2592000000.0::DOUBLE, 6) AS samples_per_s, "
    "round(loss_sum / samples, 6) AS final_loss, round(correct::DOUBLE / samples, 6) AS final_acc, "
    "'done' AS status FROM s",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one run of thirty days."""
    wall = F.lit(30 * 24 * 3600 * 1000.0)
    whole = metrics.run_summary(inputs.shard_log(spark, sf_dir), wall)
    shares = ["busy_frac", "stall_frac", "samples_per_s", "final_loss", "final_acc"]
    return whole.select(
        "shards", "samples", "bytes", *[r6(F.col(c)).alias(c) for c in shares], "status"
    )


@query(
    "with_stall",
    "SELECT event_id, round(0.05::DOUBLE + 0.1::DOUBLE, 6) AS wait_s, "
    "round(greatest(0, value / 1000.0::DOUBLE - 0.1::DOUBLE), 6) AS load_s FROM events",
)
def with_stall_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.table(spark, sf_dir, "events").select(
        "event_id", F.lit(0.05).alias("wait_s"), (F.col("value") / 1000.0).alias("host_s")
    )
    stalled = with_stall(log)
    return stalled.select("event_id", r6(F.col("wait_s")).alias("wait_s"), r6(F.col("load_s")).alias("load_s"))


# -- timelines -------------------------------------------------------------------------------------

@query(
    "publish_gap",
    f"WITH {ARRIVALS} SELECT stream, event_id, ts_us - coalesce(lag(ts_us) OVER "
    "(PARTITION BY stream ORDER BY ts_us, event_id), 0) AS gap_us FROM arrivals",
)
def publish_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = timeline.publish_gap(inputs.arrivals(spark, sf_dir), "stream", STREAM_ORDER)
    return gaps.select("stream", "event_id", "gap_us")


@query(
    "elapsed",
    f"WITH {ARRIVALS} SELECT stream, event_id, ts_us - min(ts_us) OVER (PARTITION BY stream) AS elapsed_us "
    "FROM arrivals",
)
def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = timeline.elapsed(inputs.arrivals(spark, sf_dir), "stream", STREAM_ORDER)
    return since.select("stream", "event_id", "elapsed_us")


@query(
    "running_totals",
    f"WITH {ARRIVALS} SELECT stream, event_id, (sum(n) OVER w)::BIGINT AS total_n, "
    "(sum(correct) OVER w)::BIGINT AS total_correct, (sum(bytes) OVER w)::BIGINT AS total_bytes FROM arrivals "
    "WINDOW w AS (PARTITION BY stream ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)",
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.arrivals(spark, sf_dir)
    totals = timeline.running_totals(log, "stream", STREAM_ORDER, ["n", "correct", "bytes"])
    return totals.select("stream", "event_id", "total_n", "total_correct", "total_bytes")


@query(
    "shard_ordinal",
    f"WITH {ARRIVALS} SELECT stream, event_id, row_number() OVER "
    "(PARTITION BY stream ORDER BY ts_us, event_id) AS ordinal FROM arrivals",
)
def shard_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = timeline.shard_ordinal(inputs.arrivals(spark, sf_dir), "stream", STREAM_ORDER)
    return numbered.select("stream", "event_id", "ordinal")


# All runs begin with the first instant of the clock.
RUN_START_US = 0


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.starvation(inputs.arrivals(spark, sf_dir), "stream", STREAM_ORDER, RUN_START_US)


def served_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stored log, for operators that pass over it more than once."""
    return stage(served(spark, sf_dir), "served")


@query(
    "starvation",
    f"WITH {SERVED} SELECT stream, event_id, start_us, finish_us, wait_us, queue_us FROM served",
)
def starvation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served(spark, sf_dir).select(
        "stream", "event_id", "start_us", "finish_us", "wait_us", "queue_us"
    )


@query(
    "starvation_ratio",
    f"WITH {SERVED} SELECT stream, count(*) AS shards, sum(wait_us)::BIGINT AS wait_us, "
    "sum(service_us)::BIGINT AS service_us, round(CASE WHEN max(finish_us) > 0 THEN "
    "sum(wait_us)::DOUBLE / max(finish_us) ELSE 0 END, 6) AS starvation FROM served GROUP BY 1",
)
def starvation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = timeline.starvation_ratio(served(spark, sf_dir), "stream", RUN_START_US)
    return ratio.select(
        "stream", "shards", "wait_us", "service_us", r6(F.col("starvation")).alias("starvation")
    )


@query(
    "consumer_wait",
    f"WITH {SERVED} SELECT stream, event_id, start_us - coalesce(lag(finish_us) OVER "
    "(PARTITION BY stream ORDER BY ts_us, event_id), 0) AS wait_us FROM served",
)
def consumer_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = served_log(spark, sf_dir).select("stream", *STREAM_ORDER, "start_us", "finish_us")
    waits = timeline.consumer_wait(log, "stream", STREAM_ORDER, RUN_START_US)
    return waits.select("stream", "event_id", "wait_us")


@query(
    "unaccounted_time",
    f"WITH {SHARD_LOG} SELECT run, round(wall_ms * 1000)::BIGINT AS wall_us, "
    "round((wall_ms - (wait_ms + load_ms + pin_ms + h2d_ms + train_ms)) * 1000)::BIGINT AS unaccounted_us "
    "FROM totals",
)
def unaccounted_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = timeline.unaccounted_time(totals_with_wall(spark, sf_dir), "wall_ms", PHASE_MS)
    # Whole microseconds: a run of weeks in milliseconds leaves a double no room for six decimals.
    return rest.select(
        "run",
        F.round(F.col("wall_ms") * 1000).cast("bigint").alias("wall_us"),
        F.round(F.col("unaccounted_ms") * 1000).cast("bigint").alias("unaccounted_us"),
    )


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = served_log(spark, sf_dir)
    published = log.select("stream", "shard_id", "ts_us", "bytes")
    retired = log.select("stream", "shard_id", F.col("finish_us").alias("ts_us"), "bytes")
    return timeline.backlog(published, retired, "stream")


@query(
    "backlog",
    f"WITH {HELD} SELECT stream, shard_id, ts_us, delta::BIGINT AS delta, items::BIGINT AS items, "
    "bytes_held::BIGINT AS bytes_held FROM held",
)
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).select("stream", "shard_id", "ts_us", "delta", "items", "bytes_held")


@query(
    "backlog_peak",
    f"WITH {HELD} SELECT stream, max(items)::BIGINT AS peak_items, max(bytes_held)::BIGINT AS peak_bytes "
    "FROM held GROUP BY 1",
)
def backlog_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.backlog_peak(held(spark, sf_dir), "stream")


@query(
    "lookahead_audit",
    f"WITH {SERVED} SELECT stream, event_id, coalesce(ts_us < lag(finish_us, {LOOKAHEAD}) OVER "
    "(PARTITION BY stream ORDER BY ts_us, event_id), false) AS violation FROM served",
)
def lookahead_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = served_log(spark, sf_dir).select(
        "stream",
        *STREAM_ORDER,
        F.col("ts_us").alias("publish_us"),
        F.col("finish_us").alias("retire_us"),
    )
    audited = timeline.lookahead_audit(log, "stream", STREAM_ORDER, LOOKAHEAD)
    return audited.select("stream", "event_id", "violation")


@query(
    "least_lookahead",
    f"""WITH {SERVED}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts_us, event_id) AS place FROM served),
    gone AS (
      SELECT p.stream, p.place, count(q.place) AS n FROM placed p
      LEFT JOIN placed q ON q.stream = p.stream AND q.place < p.place AND q.finish_us <= p.ts_us
      GROUP BY 1, 2)
    SELECT stream, max(place - n)::BIGINT AS least_lookahead FROM gone GROUP BY 1""",
)
def least_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.least_lookahead(held(spark, sf_dir), "stream")


@query(
    "capacity_audit",
    f"WITH {HELD} SELECT stream, shard_id, (bytes_held - bytes)::BIGINT AS held_before, bytes, "
    f"{CAP} - (bytes_held - bytes) > bytes AS fits FROM held WHERE delta = 1",
)
def capacity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = timeline.capacity_audit(held(spark, sf_dir), CAP)
    return audited.select("stream", "shard_id", "held_before", "bytes", "fits")


# -- joins of logs ---------------------------------------------------------------------------------

_PUBLISHED = "event_id % 97 <> 0"
_CONSUMED = "event_id % 89 <> 0"


@query(
    "cross_check",
    f"""WITH {SERVED}, gaps AS (
      SELECT stream, shard_id, event_id, wait_us,
             ts_us - coalesce(lag(ts_us) OVER (PARTITION BY stream ORDER BY ts_us, event_id), 0) AS gap_us
      FROM served),
    p AS (SELECT stream, shard_id, gap_us FROM gaps WHERE {_PUBLISHED}),
    c AS (SELECT stream, shard_id, wait_us FROM gaps WHERE {_CONSUMED})
    SELECT coalesce(p.stream, c.stream) AS stream, coalesce(p.shard_id, c.shard_id) AS shard_id,
           CASE WHEN c.shard_id IS NULL THEN 'published only' WHEN p.shard_id IS NULL THEN 'consumed only'
                ELSE 'both' END AS status, gap_us, wait_us, gap_us - wait_us AS gap_less_wait_us
    FROM p FULL OUTER JOIN c ON p.stream = c.stream AND p.shard_id = c.shard_id""",
)
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs of the same feed, of which each lacks some shards."""
    gaps = timeline.publish_gap(inputs.arrivals(spark, sf_dir), "stream", STREAM_ORDER)
    return joins.cross_check(
        gaps.where(_PUBLISHED), served(spark, sf_dir).where(_CONSUMED), ["stream", "shard_id"]
    )


@query(
    "pending_shards",
    f"WITH {ARRIVALS} SELECT stream, shard_id, bytes FROM arrivals WHERE {_PUBLISHED} AND NOT ({_CONSUMED})",
)
def pending_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.arrivals(spark, sf_dir).select("stream", "shard_id", "event_id", "bytes")
    pending = joins.pending_shards(
        log.where(_PUBLISHED), log.where(_CONSUMED), ["stream", "shard_id"]
    )
    return pending.select("stream", "shard_id", "bytes")


@query(
    "shape_check",
    f"WITH {DOC_SAMPLES}, m AS (SELECT sample_id // 64 AS shard_id, count(*) AS n_samples FROM samples GROUP BY 1), "
    "f AS (SELECT shard_id, n_samples, CASE WHEN shard_id % 3 = 1 THEN 1000 ELSE 1024 END::BIGINT AS seq_len, "
    "n_samples * 8200 AS n_bytes FROM m) "
    "SELECT * FROM (SELECT *, CASE WHEN seq_len <> 1024 THEN 'row length' WHEN n_samples <> 64 AND NOT "
    "(n_samples < 64 AND shard_id = (SELECT max(shard_id) FROM m)) THEN 'samples' "
    "WHEN n_bytes <> n_samples * (seq_len + 1) * 8 THEN 'bytes' WHEN n_bytes >= 2097152 THEN 'over cap' END "
    "AS fault FROM f) WHERE fault IS NOT NULL",
)
def shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document shards of which every third claims rows of another length."""
    shards = inputs.doc_shards(spark, sf_dir).groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_samples")
    )
    claimed = F.when(F.col("shard_id") % 3 == 1, F.lit(1000)).otherwise(F.lit(1024)).cast("bigint")
    manifest = shards.withColumns(
        {"seq_len": claimed, "n_bytes": F.col("n_samples") * FeedConfig().sample_bytes}
    )
    return joins.shape_check(manifest, FeedConfig())

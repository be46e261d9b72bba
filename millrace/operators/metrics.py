"""Figures over the feed's logs. Every aggregate is combined on the map side before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import PHASES, STATS_EVERY
from millrace.functions.columns import ratio, whole_div
from millrace.operators.ordered import (
    group_total,
    ordinal,
    previous,
    running_columns,
    running_sum,
)
from millrace.session import stage


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the sum of weights, the latter at least 1."""
    total = F.coalesce(F.sum(value * weight), F.lit(0.0))
    return total / F.greatest(F.coalesce(F.sum(weight), F.lit(0)), F.lit(1))


def accuracy(correct: Column) -> Column:
    """Share of rows where ``correct`` holds; 0 for no rows."""
    hits = F.coalesce(F.sum(F.when(correct, 1).otherwise(0)), F.lit(0))
    return hits / F.greatest(F.count(F.lit(1)), F.lit(1))


def phase_columns(log: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (phase, ms) to one column per phase. The phase list is fixed, so no extra job runs."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("ms"))), F.lit(0.0)).alias(f"{p}_ms")
        for p in PHASES
    ]
    return log.groupBy(*keys).agg(*sums)


def phase_rows(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One column per phase back to the long form (phase, ms)."""
    pairs = ", ".join(f"'{p}', {p}_ms" for p in PHASES)
    return wide.selectExpr(*keys, f"stack({len(PHASES)}, {pairs}) as (phase, ms)")


def run_totals(log: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Shards, samples, correct, summed loss, bytes and time per phase, from a wide shard log.

    ``more`` are further aggregates to take in the same pass, such as the wall time.
    """
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shards"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.col("loss") * F.col("n")), F.lit(0.0)).alias("loss_sum"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        *[F.coalesce(F.sum(f"{p}_ms"), F.lit(0.0)).alias(f"{p}_ms") for p in PHASES],
        *more,
    )


def utilization(totals: DataFrame, wall_ms: Column) -> DataFrame:
    """Busy, stalled and input/output shares of the wall time; 0 where there is none."""
    return totals.withColumns(
        {
            "busy_frac": ratio(F.col("train_ms"), wall_ms),
            "stall_frac": ratio(F.col("wait_ms"), wall_ms),
            "io_frac": ratio(F.col("load_ms") + F.col("pin_ms") + F.col("h2d_ms"), wall_ms),
        }
    )


def throughput(totals: DataFrame, wall_ms: Column) -> DataFrame:
    """Samples and bytes per second of wall time."""
    return totals.withColumns(
        {
            "samples_per_s": ratio(F.col("samples") * 1000.0, wall_ms),
            "bytes_per_s": ratio(F.col("bytes") * 1000.0, wall_ms),
        }
    )


def final_loss_acc(totals: DataFrame) -> DataFrame:
    """Loss and accuracy of a run, per sample."""
    n = F.greatest(F.col("samples"), F.lit(1))
    return totals.withColumns(
        {"final_loss": F.col("loss_sum") / n, "final_acc": F.col("correct") / n}
    )


def phase_distribution(
    log: DataFrame, by: list[str], approx: bool = False
) -> DataFrame:
    """n, min, median, mean, 95th percentile and max of ``ms`` per group, exact.

    The median of an even count is the mean of the middle two. The 95th percentile is the value at
    index ``floor(0.95 n)``, not above the last. Equal values are merged before any ordering, and the
    rank of each value is a running count, so no group is ever held by one task. ``approx`` swaps both
    order statistics for a mergeable sketch.
    """
    if approx:
        return log.groupBy(*by).agg(
            F.count("ms").alias("n"),
            F.min("ms").alias("min_ms"),
            F.percentile_approx("ms", 0.5).alias("p50_ms"),
            F.avg("ms").alias("mean_ms"),
            F.percentile_approx("ms", 0.95).alias("p95_ms"),
            F.max("ms").alias("max_ms"),
        )
    counted = log.where(F.col("ms").isNotNull()).groupBy(*by, "ms").agg(
        F.count(F.lit(1)).alias("times")
    )
    values = stage(counted, "phase-values")
    ranked = running_columns(
        values,
        by,
        ["ms"],
        {"upto": running_sum(F.col("times")), "n": group_total(F.col("times"))},
    )

    def at(index: Column) -> Column:
        here = (index < F.col("upto")) & (index >= F.col("upto") - F.col("times"))
        return F.max(F.when(here, F.col("ms")))

    n = F.col("n")
    late = F.least(n - 1, F.floor(F.lit(0.95) * n))
    return ranked.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.min("ms").alias("min_ms"),
        ((at(whole_div(n - 1, 2)) + at(whole_div(n, 2))) / 2.0).alias("p50_ms"),
        (F.sum(F.col("ms") * F.col("times")) / F.sum("times")).alias("mean_ms"),
        at(late).alias("p95_ms"),
        F.max("ms").alias("max_ms"),
    )


def all_phases(distribution: DataFrame) -> DataFrame:
    """A distribution by phase with a row for every phase, n = 0 where nothing was logged."""
    spark = distribution.sparkSession
    phases = spark.createDataFrame([(p,) for p in PHASES], "phase string")
    return phases.join(distribution, "phase", "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )


def run_summary(log: DataFrame, wall_ms: Column) -> DataFrame:
    """One row for a whole wide shard log, also for an empty one: zeros and ``no samples``."""
    totals = run_totals(log, [])
    rated = final_loss_acc(throughput(utilization(totals, wall_ms), wall_ms))
    status = F.when(F.col("shards") == 0, F.lit("no samples")).otherwise(F.lit("done"))
    return rated.withColumn("status", status)


def rate_every_k(
    log: DataFrame,
    stream: str,
    order: list[str],
    k: int = STATS_EVERY,
    start_us: int = 0,
) -> DataFrame:
    """Bytes and batches per second of every full group of ``k`` consecutive batches of a stream.

    A group lasts from the end of the one before it; the first one from ``start_us``, the run's start.
    """
    numbered = running_columns(
        log,
        [stream],
        order,
        {"pos": ordinal(), "before_us": previous(F.col("ts_us"))},
    ).withColumn("before_us", F.coalesce("before_us", F.lit(start_us).cast("bigint")))
    groups = numbered.groupBy(stream, whole_div(F.col("pos") - 1, k).alias("grp")).agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("bytes").alias("bytes"),
        F.min("before_us").alias("from_us"),
        F.max("ts_us").alias("to_us"),
    )
    secs = (F.col("to_us") - F.col("from_us")) / 1e6
    return groups.where(F.col("batches") == k).withColumns(
        {
            "mb_per_s": ratio(F.col("bytes") / 1e6, secs),
            "batches_per_s": ratio(F.col("batches").cast("double"), secs),
        }
    )

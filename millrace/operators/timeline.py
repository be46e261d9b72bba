"""Order-dependent figures over arrival, publish and retire logs.

Times are integer microseconds, so every result is exact. All of them are built on the range-cut
running values, so one stream may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import CAP_BYTES, CAP_ITEMS
from millrace.operators.ordered import (
    RANGE,
    carried,
    earlier,
    join_carried,
    ordinal,
    previous,
    running_columns,
    running_min,
    running_sum,
    with_range,
)


def publish_gap(
    log: DataFrame,
    stream: str,
    order: list[str],
    start_us: int = 0,
) -> DataFrame:
    """``gap_us`` since the publish before; the first counts from ``start_us``."""
    before = running_columns(
        log, [stream], order, {"_before": previous(F.col("ts_us"))}
    )
    start = F.coalesce("_before", F.lit(start_us).cast("bigint"))
    return before.withColumn("gap_us", F.col("ts_us") - start).drop("_before")


def elapsed(
    log: DataFrame, stream: str, order: list[str]
) -> DataFrame:
    """``elapsed_us`` since the first row of the stream."""
    first = running_columns(
        log, [stream], order, {"_first_us": running_min(F.col("ts_us"))}
    )
    return first.withColumn("elapsed_us", F.col("ts_us") - F.col("_first_us")).drop("_first_us")


def running_totals(
    log: DataFrame,
    stream: str,
    order: list[str],
    columns: list[str],
) -> DataFrame:
    """``total_<c>`` for each column: its sum up to and including the row."""
    outputs = {f"total_{c}": running_sum(F.col(c)) for c in columns}
    return running_columns(log, [stream], order, outputs)


def shard_ordinal(
    log: DataFrame, stream: str, order: list[str]
) -> DataFrame:
    """1-based arrival number, independent of the id in the file name."""
    return running_columns(log, [stream], order, {"ordinal": ordinal()})


def starvation(
    arrivals: DataFrame, stream: str, order: list[str], run_start_us: int | None = None
) -> DataFrame:
    """When a one-at-a-time consumer starts and finishes each shard, and how long it sat idle.

    A shard starts at the later of its arrival ``ts_us`` and the finish before it. With C the running
    sum of ``service_us`` this has a closed form, ``finish = C + max over earlier rows of
    (ts_us - C before that row)``, so no loop is needed. Adds ``start_us``, ``finish_us``, ``wait_us``
    (idle before the shard) and ``queue_us`` (how long the shard lay there). The consumer is ready from
    ``run_start_us`` on, so the first wait counts from there; without it the run begins with the first arrival.
    """
    ranged, ranges = with_range(arrivals, [stream, *order])
    rows = Window.partitionBy(RANGE, stream).orderBy(*order)
    here = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    served = ranged.withColumn("_c", F.sum("service_us").over(here))
    slack = served.withColumn("_slack", F.col("ts_us") - (F.col("_c") - F.col("service_us")))
    local = slack.withColumns(
        {"_m": F.max("_slack").over(here), "_m_before": F.max("_slack").over(before)}
    )
    if ranges == 1:
        local = local.withColumns(
            {"_c0": F.lit(0).cast("bigint"), "_m0": F.lit(None).cast("bigint")}
        )
    else:
        summary = slack.groupBy(RANGE, stream).agg(
            F.sum("service_us").alias("_sum"), F.max("_slack").alias("_top")
        )
        offset = F.coalesce(F.sum("_sum").over(earlier([stream])), F.lit(0).cast("bigint"))
        shifted = summary.withColumn("_c0", offset).withColumn("_top", F.col("_top") - F.col("_c0"))
        carry = carried(
            shifted, [stream], {"_c0": F.col("_c0"), "_m0": F.max("_top").over(earlier([stream]))}
        )
        local = join_carried(local, carry, [stream], ["_c0", "_m0"]).withColumn(
            "_c0", F.coalesce("_c0", F.lit(0).cast("bigint"))
        )
    ready = F.lit(run_start_us).cast("bigint")  # null where the run begins with the first arrival
    top = F.greatest(F.col("_m") - F.col("_c0"), F.col("_m0"), ready)
    top_before = F.greatest(F.col("_m_before") - F.col("_c0"), F.col("_m0"), ready)
    finish = F.col("_c") + F.col("_c0") + top
    return local.withColumns(
        {
            "finish_us": finish,
            "start_us": finish - F.col("service_us"),
            "wait_us": F.coalesce(top - top_before, F.lit(0).cast("bigint")),
            "queue_us": finish - F.col("service_us") - F.col("ts_us"),
        }
    ).drop(RANGE, "_c", "_slack", "_m", "_m_before", "_c0", "_m0")


def starvation_ratio(served: DataFrame, stream: str, run_start_us: int | None = None) -> DataFrame:
    """Idle share of the time from the start of the run, by default a stream's first arrival, to its last finish."""
    whole = F.col("last_us") - F.coalesce(F.lit(run_start_us).cast("bigint"), F.col("first_us"))
    return (
        served.groupBy(stream)
        .agg(
            F.count(F.lit(1)).alias("shards"),
            F.sum("wait_us").alias("wait_us"),
            F.sum("service_us").alias("service_us"),
            F.min("ts_us").alias("first_us"),
            F.max("finish_us").alias("last_us"),
        )
        .withColumn(
            "starvation", F.when(whole > 0, F.col("wait_us") / whole).otherwise(F.lit(0.0))
        )
    )


def consumer_wait(
    log: DataFrame, stream: str, order: list[str], run_start_us: int | None = None
) -> DataFrame:
    """``wait_us`` from finishing one shard to starting the next, out of logged starts and finishes.

    The first counts from ``run_start_us``; without it, it is 0.
    """
    before = running_columns(
        log, [stream], order, {"_before": previous(F.col("finish_us"))}
    )
    begin = F.coalesce(F.col("_before"), F.lit(run_start_us).cast("bigint"), F.col("start_us"))
    wait = F.col("start_us") - begin
    return before.withColumn("wait_us", wait).drop("_before")


def unaccounted_time(phases: DataFrame, wall_ms: str, phase_ms: list[str]) -> DataFrame:
    """Wall time that no phase explains."""
    spent = sum((F.col(p) for p in phase_ms[1:]), F.col(phase_ms[0]))
    return phases.withColumn("unaccounted_ms", F.col(wall_ms) - spent)


def backlog(
    published: DataFrame,
    retired: DataFrame,
    stream: str,
) -> DataFrame:
    """Shards and bytes outstanding at each instant of a stream.

    Both inputs have ``stream, shard_id, ts_us, bytes``. A retire at the same instant as a publish
    frees its place first.
    """
    columns = [stream, "shard_id", "ts_us"]
    changes = published.select(*columns, F.lit(1).cast("bigint").alias("delta"), F.col("bytes")).unionByName(
        retired.select(*columns, F.lit(-1).cast("bigint").alias("delta"), (-F.col("bytes")).alias("bytes"))
    )
    return running_columns(
        changes,
        [stream],
        ["ts_us", "delta", "shard_id"],
        {
            "items": running_sum(F.col("delta")),
            "bytes_held": running_sum(F.col("bytes")),
        },
    )


def backlog_peak(held: DataFrame, stream: str) -> DataFrame:
    return held.groupBy(stream).agg(
        F.max("items").alias("peak_items"), F.max("bytes_held").alias("peak_bytes")
    )


def lookahead_audit(
    log: DataFrame,
    stream: str,
    order: list[str],
    lookahead: int,
) -> DataFrame:
    """Marks shards published before the one ``lookahead`` places earlier was gone.

    ``log`` has ``publish_us`` and ``retire_us`` (null while a shard is still there). 0 means no limit.
    The earlier shard is found by an equi-join on its place in the stream, which is unique.
    """
    placed = running_columns(log, [stream], order, {"place": ordinal()})
    if lookahead == 0:
        return placed.withColumn("violation", F.lit(False))
    freed = placed.select(
        F.col(stream).alias("_stream"),
        (F.col("place") + lookahead).alias("_place"),
        F.col("retire_us").alias("_freed_us"),
    )
    match = (F.col(stream) == F.col("_stream")) & (F.col("place") == F.col("_place"))
    late = F.col("_freed_us").isNull() | (F.col("publish_us") < F.col("_freed_us"))
    return (
        placed.join(freed, match, "left")
        .withColumn("violation", F.col("_place").isNotNull() & late)
        .drop("_stream", "_place", "_freed_us")
    )


def least_lookahead(held: DataFrame, stream: str) -> DataFrame:
    """Smallest limit no publish of the stream would have broken: the peak of its backlog."""
    return held.groupBy(stream).agg(F.max("items").alias("least_lookahead"))


def capacity_audit(held: DataFrame, cap: int = CAP_BYTES, items: int = CAP_ITEMS) -> DataFrame:
    """Publishes only, with the bytes held before each and whether it fits.

    A batch fits when the free bytes are strictly more than its size and more than one place is free.
    """
    before = held.where(F.col("delta") == 1).withColumn("held_before", F.col("bytes_held") - F.col("bytes"))
    room = F.lit(cap) - F.col("held_before") > F.col("bytes")
    place = F.lit(items) - (F.col("items") - 1) > 1
    return before.withColumn("fits", room & place)

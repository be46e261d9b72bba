"""Running values over ordered groups of any size.

A window partitioned by the group sends a whole group to one task, which fails when one run or stream
holds a large share of all rows. Here the rows are cut into key ranges of about equal size in
(group, order) order, the window runs inside each range, and what crosses a range border is carried
over. A border falls inside at most one group, so the carried rows number at most twice the borders:
the broadcast of them is bounded by ``MAX_RANGES``, whatever the data.

The order key must be unique inside a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Rows of a range, unless the session sets ROWS_SETTING; more where MAX_RANGES would be passed.
ROWS_PER_RANGE = 100_000
ROWS_SETTING = "spark.millrace.rowsPerRange"
MAX_RANGES = 20_000
KEYS_PER_RANGE = 20
# Rows of at least WIDE_ROW bytes are cut by bytes too, into at least one range a core.
RANGE_BYTES = 64 * 1024 * 1024
WIDE_ROW = 1024
WIDTH_ROWS = 1000
RANGE = "_range"


@dataclass(frozen=True)
class Running:
    """One output of :func:`running_columns`."""

    kind: str
    value: Column


def ordinal() -> Running:
    """1-based position in the group."""
    return Running("sum", F.lit(1).cast("bigint"))


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def running_max(value: Column) -> Running:
    return Running("max", value)


def running_min(value: Column) -> Running:
    return Running("min", value)


def previous(value: Column) -> Running:
    """Value of the row before; null on the first row of a group."""
    return Running("previous", value)


def group_total(value: Column) -> Running:
    """Sum over the whole group, on each of its rows."""
    return Running("total", value)


def _search(df: DataFrame, keys: list[str], cuts: Column, n_cuts: int) -> DataFrame:
    """``df`` with the number of sorted cut keys that are not above its key, found by halving steps.

    One projection per step: each compiles to a comparison with an element of a constant array.
    """
    found = df.withColumns({RANGE: F.lit(0), "_key": F.struct(*keys)})
    for bit in reversed(range(n_cuts.bit_length())):
        ahead = F.col(RANGE) + (1 << bit)
        reached = F.col("_key") >= F.get(cuts, ahead - 1)
        found = found.withColumn(RANGE, F.when(reached, ahead).otherwise(F.col(RANGE)))
    return found.drop("_key")


def _octets(fields: Iterable[T.StructField]) -> list[Column]:
    """About how many bytes each column of unbounded size takes in a row."""
    out = []
    for field in fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            out.append(F.octet_length(column))
        elif isinstance(field.dataType, T.ArrayType):
            out.append(F.size(column) * 8)
    return [F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in out]


def row_bytes(df: DataFrame) -> float:
    """Average width of the first ``WIDTH_ROWS`` rows in their columns of unbounded size; 0 where there are none."""
    parts = _octets(df.schema.fields)
    if not parts:
        return 0.0
    widths = [r[0] for r in df.select(sum(parts[1:], parts[0])).take(WIDTH_ROWS)]
    return sum(widths) / max(len(widths), 1)


def with_range(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``df`` with the number of its key range, and how many ranges there are.

    Two passes over the key columns only: a count, and a sample of about ``KEYS_PER_RANGE`` keys per
    range (bounded by ``MAX_RANGES``) from which the cut keys are taken. Wide rows, whose width is that of
    the first ones, get more ranges. The cut keys steer balance; no result depends on them.
    """
    narrow = df.select(*keys)
    total = narrow.count()
    rows_per_range = int(df.sparkSession.conf.get(ROWS_SETTING, str(ROWS_PER_RANGE)))
    ranges = math.ceil(total / rows_per_range)
    width = row_bytes(df)
    if width >= WIDE_ROW:
        cores = df.sparkSession.sparkContext.defaultParallelism
        ranges = max(ranges, math.ceil(total * width / RANGE_BYTES), min(cores, total))
    ranges = min(MAX_RANGES, ranges)
    if ranges <= 1:
        return df.withColumn(RANGE, F.lit(0)), 1
    share = min(1.0, ranges * KEYS_PER_RANGE / total)
    sampled = narrow.sample(share, seed=ranges).agg(
        F.array_sort(F.collect_list(F.struct(*keys))).alias("k")
    )
    cuts = sampled.select(
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.lit(ranges - 1)),
                lambda i: F.get("k", F.floor(i * F.size("k") / ranges).cast("int")),
            )
        ).alias("k")
    )
    found = cuts.select(
        F.to_json(F.filter("k", lambda c: c.isNotNull())).alias("json"),
        F.size(F.filter("k", lambda c: c.isNotNull())).alias("n"),
    ).first()
    if not found["n"]:
        return df.withColumn(RANGE, F.lit(0)), 1
    key_type = T.ArrayType(T.StructType([narrow.schema[k] for k in keys]))
    literal = F.from_json(F.lit(found["json"]), key_type)
    return _search(df, keys, literal, found["n"]), found["n"] + 1


def carried(summary: DataFrame, group: list[str], columns: dict[str, Column]) -> DataFrame:
    """What earlier ranges hand to each (range, group), for the groups that lie in several ranges.

    ``summary`` has one row per (range, group); ``columns`` are window columns over
    ``earlier(group)``, ``ranges_of(group)`` or ``all_ranges(group)``.
    """
    return (
        summary.select(
            RANGE,
            *group,
            *[column.alias(name) for name, column in columns.items()],
            F.count(F.lit(1)).over(all_ranges(group)).alias("_spread"),
        )
        .where(F.col("_spread") > 1)
        .drop("_spread")
    )


def _by(group: list[str]):
    return [F.col(g) for g in group] or [F.lit(0)]


def ranges_of(group: list[str]):
    """Ranges of a group in order. Holds one row per range, never more."""
    return Window.partitionBy(*_by(group)).orderBy(RANGE)


def earlier(group: list[str]):
    return ranges_of(group).rowsBetween(Window.unboundedPreceding, -1)


def all_ranges(group: list[str]):
    return Window.partitionBy(*_by(group))


def join_carried(df: DataFrame, carry: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Attach carried columns to the rows of their range; at most two rows per border are broadcast."""
    renamed = carry.select(
        *[F.col(k).alias(f"_carry_{k}") for k in [RANGE, *group]], *[F.col(n) for n in names]
    )
    match = F.col(RANGE) == F.col(f"_carry_{RANGE}")
    for k in group:
        match = match & F.col(k).eqNullSafe(F.col(f"_carry_{k}"))
    joined = df.join(F.broadcast(renamed), match, "left")
    return joined.drop(*[f"_carry_{k}" for k in [RANGE, *group]])


def running_columns(
    df: DataFrame,
    group: list[str],
    order: list[str],
    outputs: dict[str, Running],
) -> DataFrame:
    """``df`` with running values over each group in order; see the module text."""
    ranged, ranges = with_range(df, [*group, *order])
    inputs = {f"_in_{name}": out.value for name, out in outputs.items()}
    ranged = ranged.withColumns(inputs)

    rows = Window.partitionBy(RANGE, *group).orderBy(*order)
    up_to_here = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {
        "sum": lambda c: F.sum(c).over(up_to_here),
        "max": lambda c: F.max(c).over(up_to_here),
        "min": lambda c: F.min(c).over(up_to_here),
        "previous": lambda c: F.lag(c).over(rows),
        "total": lambda c: F.sum(c).over(Window.partitionBy(RANGE, *group)),
    }
    local = ranged.withColumns(
        {name: inside[out.kind](F.col(f"_in_{name}")) for name, out in outputs.items()}
    )
    if ranges == 1:
        return local.drop(RANGE, *inputs)

    whole = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "previous": lambda c: F.max_by(c, F.struct(*order)),
        "total": F.sum,
    }
    summary = ranged.groupBy(RANGE, *group).agg(
        *[whole[out.kind](F.col(f"_in_{name}")).alias(name) for name, out in outputs.items()]
    )
    across = {
        "sum": lambda c: F.sum(c).over(earlier(group)),
        "max": lambda c: F.max(c).over(earlier(group)),
        "min": lambda c: F.min(c).over(earlier(group)),
        "previous": lambda c: F.lag(c).over(ranges_of(group)),
        "total": lambda c: F.sum(c).over(all_ranges(group)),
    }
    carry = carried(
        summary,
        group,
        {f"_carry_{name}": across[out.kind](F.col(name)) for name, out in outputs.items()},
    )
    names = [f"_carry_{name}" for name in outputs]
    if any(out.kind == "previous" for out in outputs.values()):
        local = local.withColumn("_first", F.row_number().over(rows) == 1)
    joined = join_carried(local, carry, group, names)

    def combine(kind: str, here: Column, before: Column) -> Column:
        if kind == "sum":
            return F.coalesce(here + before, here, before)
        if kind == "max":
            return F.greatest(here, before)
        if kind == "min":
            return F.least(here, before)
        if kind == "previous":
            return F.when(F.col("_first"), before).otherwise(here)
        return F.coalesce(before, here)

    return joined.withColumns(
        {
            name: combine(out.kind, F.col(name), F.col(f"_carry_{name}"))
            for name, out in outputs.items()
        }
    ).drop(RANGE, "_first", *inputs, *names)


def dense_index(
    df: DataFrame, order: list[str], name: str = "idx"
) -> DataFrame:
    """``df`` with a gapless 0-based number over the whole table in ``order``."""
    numbered = running_columns(df, [], order, {name: ordinal()})
    return numbered.withColumn(name, F.col(name) - 1)

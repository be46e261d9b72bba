"""Quality rules with adaptive thresholds, all in DataFrame expressions.

Figures of a text are whole numbers. Their distribution in each language and source is held in a mergeable
quantile sketch: counts of bins, one per whole value up to 5000 and above it 1024 per power of two, so there is no last
bin. Adding the counts of two sketches gives the sketch of both, so sketches are combined where the rows lie, merged once
more into those of a language and of everything, and are of bounded size each. A quantile is exact up to 5000, and to
a thousandth above.

From the quartiles of its group a figure gets a fence, quartile + 3 * spread + slack, in place of a fixed cutoff. A quartile
counts as the outer end of its bin, so bins never make a fence narrower; figures are compared with it as they are. A group
of few rows uses the sketch of its language, then that of all. The fences are joined to the rows, which are filtered by
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.session import stage

SPACES = " \\t\\n\\x0B\\f\\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# A group needs so many rows for a sketch of its own.
LEAST_ROWS = 200
# Fixed values of the fences: figure, slack above, whether there is a fence below too.
FIGURES = (
    ("symbols", 50, False),  # symbols per 1000 characters in words
    ("capitals", 150, False),  # A-Z per 1000 characters in words
    ("word_length", 200, True),  # hundredths of a character
    ("dup_lines", 250, False),  # repeated lines per 1000 lines
    ("repeats", 200, False),  # repeated words per 1000 words
)
# Up to here a bin is one value; above, bins are as wide as the power of two below the value over 1024.
LINEAR = 5000
BINS_LOG2 = 10
SPREADS = 3
BASE_LEAST_WORDS = 10


def _octets(c: Column) -> Column:
    return F.octet_length(c)


def text_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``_id``, the group columns ``_g0 …``, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)],
        F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "").alias("lines"),
        (_octets(text) - _octets(bare)).cast("bigint").alias("n_symbols"),
        (_octets(text) - _octets(F.regexp_replace(text, "[A-Z]+", ""))).cast("bigint").alias("n_capitals"),
    )
    keep = ["_id", *[f"_g{k}" for k in range(len(by))], "n_symbols", "n_capitals"]
    n = F.size("words")
    # A window is known by a hash of its five words; within one text equal hashes stand for equal windows.
    windows = F.transform(
        F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    counted = split.select(
        *keep,
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    keep += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    placed = counted.select(
        *keep,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
    )
    last = F.size("sorted") - 1
    hash_at = lambda k: F.get("sorted", k)["h"]
    found = placed.select(
        *keep,
        F.when(
            F.col("sorted").isNotNull(),
            F.array_sort(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), last),
                        lambda k: ((k > 0) & (hash_at(k) == hash_at(k - 1))) | ((k < last) & (hash_at(k) == hash_at(k + 1))),
                    ),
                    lambda k: F.get("sorted", k)["i"],
                )
            ),
        ).alias("at"),
    )
    # Windows overlap: each repeated one adds the words up to where the next one begins.
    covered = F.aggregate(
        F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )
    return found.select(*keep, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def _per(part: str, whole: str, scale: int = 1000) -> Column:
    return F.when(F.col(whole) > 0, F.floor(scale * F.col(part) / F.col(whole))).otherwise(0).cast("bigint")


def _values() -> dict[str, Column]:
    return {
        "symbols": _per("n_symbols", "word_chars"),
        "capitals": _per("n_capitals", "word_chars"),
        "word_length": _per("word_chars", "n_words", 100),
        "dup_lines": _per("n_dup_lines", "n_lines"),
        "repeats": _per("n_repeat_words", "n_words"),
    }


def _width(c: Column) -> Column:
    """Width of the bin that a whole value lies in."""
    doubled = F.greatest(F.length(F.bin(c)) - 1 - BINS_LOG2, F.lit(0))
    return F.when(c > LINEAR, F.call_function("shiftleft", F.lit(1).cast("bigint"), doubled)).otherwise(F.lit(1).cast("bigint"))


def _bin(c: Column) -> Column:
    """Least value of the bin that a whole value lies in."""
    return F.greatest(c - c % _width(c), F.least(c, F.lit(LINEAR + 1)))


def _bin_end(c: Column) -> Column:
    """Largest value of the bin whose least value is given."""
    return c - c % _width(c) + _width(c) - 1


def sketches(figures: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of bins ``groups, _level, figure, bin, n``; level 0 is a group, 1 the first column, 2 everything.

    Rows without words are in no sketch. Counts are combined before they are shuffled, so a hot group sends one
    row per bin and task.
    """
    stacked = figures.where("n_words > 0").select(
        *groups,
        F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), _bin(c).alias("bin")) for k, c in enumerate(_values().values())])).alias("f"),
    )
    own = stacked.groupBy(*groups, "f.figure", "f.bin").agg(F.count(F.lit(1)).alias("n"))
    by_first = own.groupBy(groups[0], "figure", "bin").agg(F.sum("n").alias("n"))
    whole = by_first.groupBy("figure", "bin").agg(F.sum("n").alias("n"))
    nulls = {g: F.lit(None).cast(figures.schema[g].dataType) for g in groups}
    levels = [
        own.withColumn("_level", F.lit(0)),
        by_first.withColumns({**{g: nulls[g] for g in groups[1:]}, "_level": F.lit(1)}),
        whole.withColumns({**nulls, "_level": F.lit(2)}),
    ]
    columns = [*groups, "_level", "figure", "bin", "n"]
    return levels[0].select(columns).unionByName(levels[1].select(columns)).unionByName(levels[2].select(columns))


def fences(bins: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, _level, rows, low_<figure>, high_<figure>`` from sketches. A sketch has at most 5001 rows and 1024 more per power of two."""
    key = Window.partitionBy(*groups, "_level", "figure")
    ranked = bins.withColumns(
        {"total": F.sum("n").over(key), "behind": F.sum("n").over(key.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))}
    )
    quartiles = ranked.groupBy(*groups, "_level", "figure").agg(
        F.max("total").alias("rows"),
        F.min(F.when(4 * F.col("behind") >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("behind") >= 3 * F.col("total"), F.col("bin"))).alias("q3"),
    )
    quartiles = quartiles.withColumn("q3", _bin_end(F.col("q3")))
    spread = SPREADS * (F.col("q3") - F.col("q1"))
    out = [F.max("rows").alias("rows")]
    for k, (name, slack, two_sided) in enumerate(FIGURES):
        here = F.col("figure") == k
        out.append(F.max(F.when(here, F.col("q3") + spread + slack)).alias(f"high_{name}"))
        if two_sided:
            out.append(F.max(F.when(here, F.col("q1") - spread - slack)).alias(f"low_{name}"))
    return quartiles.groupBy(*groups, "_level").agg(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the figures, ``base_failed`` and ``kept`` of every row.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated windows of five. ``kept``: not that,
    and every figure within the fence of its language and source. A null text is an empty one. A null language or source is a
    group like any other. Rows are kept as they come, repeated ones too; no rows give none. Other columns are
    not passed on.

    The figures are written once to the shared folder: they are small, and the texts are read once.
    """
    groups = [f"_g{k}" for k in range(len(by))]
    figures = stage(text_figures(docs, id_col, text_col, by), "text-figures")
    marks = fences(sketches(figures, groups), groups)
    names = [c for c in marks.columns if c not in (*groups, "_level")]
    levels = [
        marks.where(F.col("_level") == k).select(*[F.col(g).alias(f"{g}_{k}") for g in groups[: len(groups) if k == 0 else 1 if k == 1 else 0]], *[F.col(c).alias(f"{c}_{k}") for c in names])
        for k in (0, 1, 2)
    ]
    # One row of fences per group: its own where it has rows enough, else its language's, else everything's.
    first = levels[0].join(levels[1], F.col(f"{groups[0]}_0").eqNullSafe(F.col(f"{groups[0]}_1")))
    all_rows = F.broadcast(levels[2])  # one row
    chosen = first.join(all_rows, F.col("rows_2") > 0)
    pick = lambda c: F.when(F.col("rows_0") >= LEAST_ROWS, F.col(f"{c}_0")).when(F.col("rows_1") >= LEAST_ROWS, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    table = chosen.select(*[F.col(f"{g}_0") for g in groups], *[pick(c).alias(c) for c in names if c != "rows"])
    on = None
    for g in groups:
        same = F.col(g).eqNullSafe(F.col(f"{g}_0"))
        on = same if on is None else on & same
    joined = figures.join(table, on, "left")
    values = _values()
    within = F.lit(True)
    for name, _, two_sided in FIGURES:
        within = within & (values[name] <= F.col(f"high_{name}"))
        if two_sided:
            within = within & (values[name] >= F.col(f"low_{name}"))
    failed = (F.col("n_words") < BASE_LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce(~failed & within, F.lit(False)).alias("kept"),
    )

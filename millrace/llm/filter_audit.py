"""Which of five filters removes what, in every order: exact Shapley shares by constrained least squares.

1. Each whole text is read once: the conditions A to D are bits of a mask, the text itself becomes a digest of 16 bytes. A text is a
   repeat (E) if its digest has a smaller id anywhere in the table; rows that are no repeat are found by a join on (digest,
   least id), so a group of copies of any size meets in no task.
2. All that orders need is how many documents of a part each coalition of filters removes: 32 numbers a part, three times (all,
   good, toxic). They are counts of masks, added up on the map side.
3. For a part, the shares minimise the kernel-weighted squares  sum over S of w(S) * (v(S) - sum of shares in S)**2  under the
   condition that they add up to v(all). Its normal equations with that condition are solved in rationals, so the shares are
   the Shapley values exactly, and 120 times a share is a whole number. Differences of coalitions are the counts of each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import text_rows
from millrace.operators.joins import hot_keys, join_apart
from millrace.session import stage

FILTERS = "ABCDE"
# Fixed values of the conditions.
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
_SIGNS = b"#$%&*|"
_CAPITALS = bytes(range(0x41, 0x5B))

FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def conditions(text: str) -> int:
    """Bits of the conditions A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # splits bytes at just the six characters that part words
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * len(text)) << 2
        | (len(raw.translate(None, _SIGNS)) < len(raw)) << 3
    )


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, mask, h`` of every row; nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for _, texts in text_rows(iter([batch.select(["text", "text"])])):
                found += [conditions(t) for t in texts]
                digests += [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "h"]
            )

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    taken = docs.select(F.col(id_col).alias("id"), part.alias("part"), F.col(text_col).alias("text"))
    return taken.mapInArrow(run, f"id {kind}, part string, mask int, h binary")


def weighted_shares(removed: Sequence[int], filters: int = len(FILTERS)) -> list[Fraction]:
    """The shares of ``removed[S]``, a number for each coalition S (a mask), by least squares that add up to the whole.

    With kernel weights w(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)) these are the Shapley values.
    """
    n, full = filters, (1 << filters) - 1
    # Normal equations of the squares, with the multiplier of the condition as the last unknown.
    rows = [[Fraction(0)] * (n + 2) for _ in range(n + 1)]
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            for j in inside:
                rows[i][j] += weight
            rows[i][-1] += weight * removed[s]
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    rows[n][-1] = Fraction(removed[full])
    for k in range(n + 1):
        held = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[held] = rows[held], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                factor = rows[r][k]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[k])]
    return [rows[i][-1] for i in range(n)]


def coalitions(counts: Sequence[int]) -> list[int]:
    """From the documents of each mask, those that each coalition removes."""
    whole = sum(counts)
    # What a coalition leaves are the masks within its complement.
    within = list(counts)
    for bit in range(len(FILTERS)):
        for s in range(len(within)):
            if s >> bit & 1:
                within[s] += within[s ^ (1 << bit)]
    return [whole - within[(len(within) - 1) ^ s] for s in range(len(within))]


def steps(part: str, documents: Sequence[int], good: Sequence[int], toxic: Sequence[int]) -> Iterator[tuple]:
    """(part, order, step, figures…) of every order and step, from the counts of each mask."""
    n, full = len(FILTERS), (1 << len(FILTERS)) - 1
    gone, good_gone, toxic_gone = coalitions(documents), coalitions(good), coalitions(toxic)
    shares = [int(x * factorial(n)) for x in weighted_shares(gone)]
    whole = sum(documents)
    for order in permutations(range(n)):
        name, held = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = held | 1 << i
            removed = gone[now] - gone[held]
            yield (
                part, name, step, whole - gone[now], removed, gone[1 << i] - removed, gone[full] - gone[full ^ 1 << i],
                good_gone[now] - good_gone[held], toxic_gone[now] - toxic_gone[held], shares[i],
            )
            held = now


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    good_col: str = "quality",
    toxic_col: str = "toxic",
) -> DataFrame:
    """``part, filter_order, step`` and the counts of each step, for every part, order of the five filters and step.

    A null text is the empty one, a null part the empty string. Repeated rows count each; of rows of one id and one text none
    repeats the other. A row without an id has no label, repeats nothing and is repeated by nothing. An id with several labels is
    good or toxic if one of them says so. Labels of no document are not counted. Extra columns are not read. No rows give none.
    """
    n = len(FILTERS)
    # Equal rows are one from here on, however many there are.
    rows = stage(
        masks(docs, id_col, text_col, part_col).groupBy("id", "part", "mask", "h").agg(F.count(F.lit(1)).alias("n")), "audit-masks"
    )
    named = rows.where("id IS NOT NULL")
    least = named.groupBy("h").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    named = named.join(least, ["h", "id"], "left").select(
        "id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << n - 1)).alias("mask"), "n"
    )
    named = stage(named.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")), "audit-ids")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        is_one(good_col).alias("good"), is_one(toxic_col).alias("toxic")
    ).where("good + toxic > 0")
    # An id may hold any share of the rows, each with a text of its own.
    hot = stage(hot_keys(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id"), "audit-hot")
    marked = join_apart(named, marks, "id", hot, "left").select("part", "mask", "n", "good", "toxic")
    unnamed = rows.where("id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    every = marked.unionByName(unnamed)
    size = 1 << n
    picked = lambda m, value: F.sum(F.when(F.col("mask") == m, value).otherwise(F.lit(0)))
    by_mask = every.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    table = by_mask.groupBy("part").agg(
        *[F.array(*[picked(m, F.col(c)) for m in range(size)]).alias(c) for c in ("n", "good", "toxic")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "filter_order", "step", *FIGURES]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(FIGURES)]
        for batch in batches:
            for row in batch.to_pylist():
                out = list(zip(*steps(row["part"], row["n"], row["good"], row["toxic"])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return table.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in FIGURES))


def audit_sql() -> str:
    """The same by going through all orders, as DuckDB SQL over ``documents`` and ``labels``."""
    letters = ", ".join(f"('{c}', {i})" for i, c in enumerate(FILTERS))
    return rf"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        min(doc_id) OVER (PARTITION BY text) AS least FROM texts
), marked AS (
    SELECT doc_id, part,
        CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask
    FROM words
), known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), counted AS MATERIALIZED (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM marked LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters(c, bit) AS (
    VALUES {letters}
), orders AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), turns AS (
    SELECT filter_order, s.step::INTEGER AS step, bits[s.step] AS bit,
        coalesce(list_sum(list_transform(bits[1:s.step - 1], lambda x: 1 << x)), 0)::BIGINT AS before
    FROM orders, range(1, 6) s(step)
), stepped AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | (1 << bit)) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << bit) != 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before != 0 AND mask & (1 << bit) != 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = 1 << bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << bit) != 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << bit) != 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM turns, counted GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM stepped"""

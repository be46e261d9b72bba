"""Codes of vectors by integer codebooks, with fixed pivots that save exact evaluations.

Components are whole numbers and a vector is cut into equal parts; each part position has a codebook of at most 256 entries. A round
gives every part the nearest entry of its codebook and moves each entry to the mean of its parts, all in whole numbers,
so results do not depend on the order in which rows come.

The nearest entry is found as LAESA does. Per part position a few of the first entries become fixed pivots. The distances of each part
to them are computed once, while rows are stored; they hold in every round. Each round needs only the distances
between pivots and moved entries: |d(part, pivot) - d(entry, pivot)| is at most d(part, entry). The largest of these bounds orders the
entries; the first few are evaluated exactly, then those whose bound does not rule them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import HOT_SHARE
from millrace.session import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
PIVOTS = 8
# Entries of least bound that are evaluated before the others are ruled out.
AHEAD = 8
BLOCK = 4096
# Whole components are below this, so squared distances of wide parts stay within 64 bits.
LARGEST = 1 << 24
# Bounds are taken as smaller by so much of the distances, for pivot distances are kept in single precision.
SLACK = 1e-6


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of integer points to a few others, one column each."""
    return np.stack([np.sqrt(((points - t) ** 2).sum(axis=1).astype(np.float64)) for t in to], axis=1)


def far_apart(entries: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``entries`` that become pivots: the first, then each time the one farthest from those taken."""
    picked = [0]
    reach = distances(entries, entries[:1])[:, 0]
    while len(picked) < min(count, len(entries)):
        picked.append(int(reach.argmax()))
        reach = np.minimum(reach, distances(entries, entries[picked[-1:]])[:, 0])
    return np.array(picked)


def nearest_entries(points: np.ndarray, reach: np.ndarray, entries: np.ndarray, entry_reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(least index of a nearest entry, squared distance, number of exact evaluations) for each point.

    ``reach`` and ``entry_reach`` are the distances of points and entries to the pivots.
    """
    n, m = len(points), len(entries)
    low = np.zeros((n, m))
    for pivot in range(entry_reach.shape[1]):
        here, there = reach[:, pivot, None].astype(np.float64), entry_reach[None, :, pivot]
        np.maximum(low, np.abs(here - there) - SLACK * (here + there), out=low)
    low -= 1e-5  # rounding of roots
    np.maximum(low, 0, out=low)
    ahead = min(AHEAD, m)
    first = np.argpartition(low, ahead - 1, axis=1)[:, :ahead] if ahead < m else np.broadcast_to(np.arange(m), (n, m))
    squares = ((points[:, None, :] - entries[first]) ** 2).sum(axis=2)
    best = squares.min(axis=1)
    index = np.where(squares == best[:, None], first, m).min(axis=1)
    open_ = low**2 <= best[:, None]
    np.put_along_axis(open_, first, False, axis=1)
    row, entry = np.nonzero(open_)
    for at in range(0, len(row), 1 << 18):
        r, e = row[at : at + (1 << 18)], entry[at : at + (1 << 18)]
        more = ((points[r] - entries[e]) ** 2).sum(axis=1)
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        least = np.minimum.reduceat(more, begin)
        lowest = np.minimum.reduceat(np.where(more == np.repeat(least, np.diff(np.append(begin, len(r)))), e, m), begin)
        who = r[begin]
        closer = (least < best[who]) | ((least == best[who]) & (lowest < index[who]))
        best[who[closer]], index[who[closer]] = least[closer], lowest[closer]
    return index, best, n * ahead + len(row)


class Codebooks:
    """Entries of all part positions, and the fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: int = PIVOTS) -> None:
        self.entries = entries  # part, entry, place
        self.pivots = [part[far_apart(part, pivots)] for part in entries]

    def reach(self, points: np.ndarray) -> np.ndarray:
        """Distances of the parts ``row, part, place`` to the pivots of their position: ``row, part, pivot``."""
        return np.stack([distances(points[:, p], pivots) for p, pivots in enumerate(self.pivots)], axis=1).astype(np.float32)

    def assign(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part, its squared distance) of the parts ``row, part, place``."""
        index, square = np.zeros(points.shape[:2], np.int64), np.zeros(points.shape[:2], np.int64)
        for p, entries in enumerate(self.entries):
            there = distances(entries, self.pivots[p])
            for at in range(0, len(points), BLOCK):
                held = slice(at, at + BLOCK)
                index[held, p], square[held, p], _ = nearest_entries(points[held, p], reach[held, p], entries, there)
        return index, square

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> None:
        """Put each used entry at the mean of its parts, rounded down."""
        self.entries = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            self.entries[part, entry] = [t // n for t in total]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _parts_of(column: pa.Array, parts: int, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), parts, width).astype(kind)


def _round(stored: DataFrame, books: Codebooks, parts: int, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Rows and component sums of each used entry. A task sums up what it reads; at most one row an entry comes to the driver."""
    pivots = len(books.pivots[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = books.entries.shape[1]
        n, sums = np.zeros((parts, many), np.int64), np.zeros((parts, many, width), np.int64)
        for batch in batches:
            points = _parts_of(batch.column(0), parts, width, np.int64)
            index, _ = books.assign(points, _parts_of(batch.column(1), parts, pivots, np.float32))
            for p in range(parts):
                order = np.argsort(index[:, p], kind="stable")
                begin = np.flatnonzero(np.append(True, np.diff(index[order, p]) != 0))
                used = index[order[begin], p]
                n[p, used] += np.diff(np.append(begin, len(order)))
                sums[p, used] += np.add.reduceat(points[order, p], begin, axis=0)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    found = stored.select("whole", "reach").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = lambda i: F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}")
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[total(i) for i in range(width)]).collect()
    return {(r.part, r.entry): (r.n, [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def compress(
    vectors: DataFrame,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    parts: int = PARTS,
    pivots: int = PIVOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    Vectors that are null or hold null or non-finite components are dropped; those left must be of one width, a multiple of
    ``parts``, with floor(1024 * x) below 2**24 in size, otherwise a ValueError says so. Codebooks start with the
    vectors of least id; of one id, in the order of their components; rows without an id come last. Fewer vectors than
    ``entries`` give smaller codebooks. Repeated rows count each and get a row each. Rows without a label are one label. No
    vectors give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * SCALE))
    taken = vectors.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("whole"))
    ids, labels = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    largest = F.coalesce(F.array_max(F.transform("whole", F.abs)), F.lit(0))
    least, most, top = taken.agg(F.min(F.size("whole")), F.max(F.size("whole")), F.max(largest)).first()
    if least is None:
        return spark.createDataFrame([], f"{id_col} {ids}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    if least != most or least % parts or top >= LARGEST:
        raise ValueError(f"vectors of {least} to {most} components, up to {top} in size, do not make {parts} equal parts of whole numbers below {LARGEST}")
    width = least // parts
    start = taken.orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).collect()  # bounded: the first codebook
    held = np.array([r.whole for r in start], np.int64).reshape(len(start), parts, width)
    books = Codebooks(held.transpose(1, 0, 2).copy(), pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = books.reach(_parts_of(batch.column(2), parts, width, np.int64)).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(reach), pa.list_(pa.float32()))], ["id", "label", "whole", "reach"])

    narrow = taken.withColumn("whole", F.col("whole").cast("array<int>"))
    stored = stage(narrow.mapInArrow(measure, f"id {ids}, label {labels}, whole array<int>, reach array<float>"), "codes-parts")
    for _ in range(rounds):
        books.moved(_round(stored, books, parts, width))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _parts_of(batch.column(2), parts, width, np.int64)
            index, square = books.assign(points, _parts_of(batch.column(3), parts, len(books.pivots[0]), np.float32))
            codes = [bytes(row).hex() for row in index.astype(np.uint8)] if entries <= 256 else ["".join(f"{x:04x}" for x in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes), pa.array(square.sum(axis=1))], ["id", "label", "code", "error"])

    coded = stage(stored.mapInArrow(encode, f"id {ids}, label {labels}, code string, error bigint"), "codes")
    return _with_label_errors(coded).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Each row with the error summed over its label. Labels that hold many rows are few, so their sums are broadcast."""
    sums = stage(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    share = max(1, (sums.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    same = F.col("label").eqNullSafe(F.col("_label"))
    few, rest = F.broadcast(sums.where(F.col("n") > share)), sums.where(F.col("n") <= share)
    return coded.join(few, same).select(*coded.columns, "label_error").union(
        coded.join(few, same, "left_anti").join(rest, same).select(*coded.columns, "label_error")
    )


def compress_sql(entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> str:
    """The same with all distances computed, as DuckDB SQL over ``embeddings``."""
    books = [
        "whole AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn, vec_id, label, v FROM (SELECT vec_id, label,"
        f" list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL"
        " AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))",
        f"cells AS MATERIALIZED (SELECT rn, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS d, v[i] AS x"
        " FROM (SELECT rn, v, unnest(range(1, len(v) + 1)) AS i FROM whole))",
        f"book0 AS MATERIALIZED (SELECT p, rn - 1 AS e, d, x FROM cells WHERE rn <= {entries})",
    ]
    for k in range(rounds + 1):
        books.append(
            f"best{k} AS MATERIALIZED (SELECT rn, p, arg_min(e, far * {entries} + e) AS e, min(far) AS far FROM (SELECT rn, p, e,"
            f" sum((a.x - b.x) * (a.x - b.x))::HUGEINT AS far FROM cells a JOIN book{k} b USING (p, d) GROUP BY rn, p, e) GROUP BY rn, p)"
        )
        if k < rounds:
            books.append(
                f"mean{k} AS (SELECT p, e, d, sum(x)::BIGINT AS s, count(*) AS c FROM cells JOIN best{k} USING (rn, p) GROUP BY p, e, d)"
            )
            books.append(
                f"book{k + 1} AS MATERIALIZED (SELECT p, e, d, CASE WHEN c IS NULL THEN x ELSE (s - ((s % c) + c) % c) // c END AS x"
                f" FROM book{k} LEFT JOIN mean{k} USING (p, e, d))"
            )
    return (
        "WITH " + ",\n".join(books) + f""",
coded AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM best{rounds} GROUP BY rn),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM whole JOIN coded USING (rn), digest"""
    )

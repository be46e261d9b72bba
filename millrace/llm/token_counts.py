"""Token counts of whole texts by a map-side lookup in two tiers.

First tier: a table of the lengths, in tokens, of frequent pre-tokens, made once over the whole corpus and
broadcast. Second tier: a table in each worker that learns the rest as they come and is emptied when full.
No pre-token is shuffled: what is counted to find the frequent ones is summed up within each task, and only
summaries of a fixed size leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import splitter, text_rows
from millrace.llm.library_tokens import library
from millrace.llm.pretokens import HashTable, chunks, text_of

# Entries of the broadcast table: at 12 bytes and half load, 3 MB.
FREQUENT = 1 << 16
# Entries of one task's summary, and counters a task holds while it counts.
SUMMARY = 1 << 13
COUNTERS = 1 << 18
# Summaries that one merge takes in.
FAN_IN = 32
_TIER = np.dtype([("hash", np.uint64), ("count", np.int64), ("tokens", np.int32)])


def _heaviest(rows: np.ndarray, n: int) -> np.ndarray:
    if len(rows) <= n:
        return rows
    return rows[np.lexsort((rows["hash"], -rows["count"]))[:n]]


def _summed(rows: np.ndarray) -> np.ndarray:
    hashes, first, inverse = np.unique(rows["hash"], return_index=True, return_inverse=True)
    out = rows[first]
    out["count"] = np.bincount(inverse, weights=rows["count"], minlength=len(hashes)).astype(np.int64)
    return out


def _summary(batches: Iterator[pa.RecordBatch], path: str) -> np.ndarray:
    """The heaviest pre-tokens of a task's texts, with their lengths. Light ones are let go when there are
    too many counters, so a count may be low; it only decides which lookups are fast."""
    tokens = library(path)
    counts = np.zeros(0, _TIER)
    words: dict[int, str] = {}
    for _, texts in text_rows(batches):
        plain = [p for text in texts for p in tokens.parts(text) if isinstance(p, str)]
        for held, _ in chunks(plain):
            points, starts, ends, hashes, _ = splitter().split(held)
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            rows = np.zeros(len(found), _TIER)
            rows["hash"], rows["count"] = found, n
            counts = _summed(np.concatenate([counts, rows]))
            often = first[n > 1]
            words.update(zip(hashes[often].tolist(), (text_of(points[a:b]) for a, b in zip(starts[often], ends[often]))))
            if len(counts) > COUNTERS or len(words) > COUNTERS:
                counts = _heaviest(counts, COUNTERS // 2)
                kept = set(counts["hash"].tolist())
                words = {h: w for h, w in words.items() if h in kept}
    known = counts[np.isin(counts["hash"], np.fromiter(words, np.uint64, len(words)))]
    out = _heaviest(known, SUMMARY)
    _, lengths = tokens.cached.encode([words[h] for h in out["hash"].tolist()])
    out["tokens"] = lengths
    return out


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", entries: int = FREQUENT) -> HashTable:
    """Lengths in tokens of the pre-tokens that are frequent over all texts, as a table of bounded size.

    Each task gives one summary of at most ``SUMMARY`` entries. Summaries are merged in groups, level by
    level, and the last few on the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int64()), pa.array([_summary(batches, path).tobytes()], pa.binary())],
            ["task", "summary"],
        )

    def merge(rows: pa.Table) -> pa.Table:
        held = np.concatenate([np.frombuffer(s.as_py(), _TIER) for s in rows["summary"]])
        best = _heaviest(_summed(held), entries)
        return pa.table({"task": pa.array([min(rows["task"].to_pylist())], pa.int64()), "summary": pa.array([best.tobytes()], pa.binary())})

    schema = "task bigint, summary binary"
    scan = docs.select(F.lit(0).alias("_"), text_col)
    parts = scan.mapInArrow(count, schema)
    n, wide = docs.rdd.getNumPartitions(), 1
    while n > FAN_IN:
        wide *= FAN_IN
        n = -(-n // FAN_IN)
        parts = parts.groupBy(F.expr(f"task div {wide}").alias("_group")).applyInArrow(merge, schema)
    # At most FAN_IN summaries of at most ``entries`` rows of 20 bytes: 42 MB.
    rows = [np.frombuffer(r["summary"], _TIER) for r in parts.collect()]
    best = _heaviest(_summed(np.concatenate(rows)), entries) if rows else np.zeros(0, _TIER)
    table = HashTable(max(4, entries.bit_length()))
    table.add(best["hash"], best["tokens"])
    return table


def count_tokens(
    docs: DataFrame,
    path: str = public_tokenizers.path("byte_bpe_50k.json"),
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    entries: int = FREQUENT,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, as the library counts.

    A null or empty text has no bytes and no tokens. Rows are kept as they come, repeated ones and ones with
    a null id too; no rows give none. Other columns are not passed on. Two passes over the texts; the second
    one shuffles nothing.
    """
    spark = docs.sparkSession
    table = frequent_lengths(docs, path, text_col, entries)
    first_tier = spark.sparkContext.broadcast((table.bits, table.keys, table.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library(path)
        frequent = HashTable(4)
        frequent.bits, frequent.keys, frequent.values = first_tier.value
        cached = tokens.cached
        for keys, texts in text_rows(batches):
            counts = np.zeros(len(texts), np.int64)
            plain, owner = [], []
            for i, text in enumerate(texts):
                for part in tokens.parts(text):
                    if isinstance(part, int):
                        counts[i] += 1
                    else:
                        plain.append(part)
                        owner.append(i)
            for held, of_part in chunks(plain):
                points, starts, ends, hashes, piece = splitter().split(held)
                if not len(hashes):
                    continue
                lengths = frequent.find(hashes).astype(np.int64)
                miss = np.flatnonzero(lengths < 0)
                if len(miss):
                    row = cached.rows(points, starts[miss], ends[miss], hashes[miss])
                    lengths[miss] = cached.counts[row]
                text = np.array(owner)[np.array(of_part)[piece]]
                counts += np.bincount(text, weights=lengths, minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(pc.binary_length(pa.array(texts, pa.large_string())).to_numpy(), pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(counts > limit),
                ],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )

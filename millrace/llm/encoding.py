"""Encoding of whole texts through a bounded table of pre-tokens that were encoded before."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.pretokens import HashTable, Splitter, chunks, text_of

# Encodes pre-tokens: (all ids one after another, number of ids of each).
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

_MEMORY = "millrace_worker_memory"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has a column of that name; Spark does not tell case apart."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def once_per_worker(key: object, make: Callable[[], object]):
    """What ``make`` gives, made once in each worker process.

    Functions travel with their task by value, so their modules' globals are new in each task; a module of the process
    keeps what is costly to make.
    """
    held = sys.modules.setdefault(_MEMORY, ModuleType(_MEMORY)).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def splitter() -> Splitter:
    """The worker's splitter."""
    return once_per_worker("splitter", Splitter)


class CachedEncoder:
    """Ids of texts. A pre-token is encoded once per worker and then looked up.

    The table holds at most 2**(bits - 1) pre-tokens and is emptied when it is full, so its memory is
    bounded whatever the texts hold.
    """

    def __init__(self, encode: Encode, bits: int = 21) -> None:
        self.encode, self.bits = encode, bits
        self._empty()

    def _empty(self) -> None:
        self.table = HashTable(self.bits)
        self.offsets = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    @staticmethod
    def _fitted(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, counts = self.encode(words)
        n, rows = len(words), self.table.size
        self.offsets = self._fitted(self.offsets, rows + n)
        self.counts = self._fitted(self.counts, rows + n)
        self.flat = self._fitted(self.flat, self.used + len(ids))
        self.counts[rows : rows + n] = counts
        self.offsets[rows : rows + n] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.table.add(hashes, np.arange(rows, rows + n, dtype=np.int32))

    def rows(self, points, starts, ends, hashes) -> np.ndarray:
        row = self.table.find(hashes)
        miss = np.flatnonzero(row < 0)
        if not len(miss):
            return row
        _, first = np.unique(hashes[miss], return_index=True)
        if self.table.size + len(first) > self.table.limit or self.used > 8 * self.table.limit:
            while len(hashes) > 1 << (self.bits - 1):  # one piece of more pre-tokens than the table takes
                self.bits += 1
            self._empty()
            miss = np.arange(len(hashes))
            _, first = np.unique(hashes, return_index=True)
        first = miss[np.sort(first)]
        self._learn(hashes[first], [text_of(points[a:b]) for a, b in zip(starts[first], ends[first])])
        return self.table.find(hashes)

    def ids(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids of its next piece) in order; a text without ids gives no piece."""
        for held, owner in chunks(texts):
            points, starts, ends, hashes, of = splitter().split(held)
            if not len(hashes):
                continue
            row = self.rows(points, starts, ends, hashes)
            counts = self.counts[row]
            behind = np.cumsum(counts)
            at = np.repeat(self.offsets[row] - (behind - counts), counts) + np.arange(behind[-1])
            ids = self.flat[at]
            ends_of = behind[np.flatnonzero(np.append(of[1:] != of[:-1], True))]
            first = 0
            for piece, last in zip(of[np.append(True, of[1:] != of[:-1])].tolist(), ends_of.tolist()):
                yield owner[piece], ids[first:last]
                first = last


def text_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of two-column batches, a few rows at a time; a null text is an empty one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]

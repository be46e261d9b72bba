"""Hierarchical packing of tokenized documents into windows of several sizes.

Sizes are powers of two. A document first fills whole windows of the largest size by itself. Its rest is
routed to the smallest tier that holds it. Each tier packs its rests into windows of its size, the largest
tier first; the gap behind a rest is filled from the shorter tiers, with the longest rest that fits, and the
last bit by cutting one. So every window is full, and the windows of all tiers need no padding.

Packing happens where a document was tokenized: nothing is shuffled, and a task that runs again gives windows
of its own documents again. What one task has left at its end is less than one window; it goes out in windows
of falling powers of two. Windows are dealt to step groups of equal numbers of tokens, by tier; the last,
part-filled groups of the tiers are joined.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.encoding import text_rows
from millrace.llm.library_tokens import library

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
# Rests that are packed together: at most 8,192 x 2,047 ids of 4 bytes, 67 MB.
BLOCK = 1 << 13
# Tokens of one step group.
STEP = 16 * WINDOW
SEPARATOR = 1
# Sequence numbers of one task.
_TASK_BITS = 36
COLUMNS = (
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("tier", pa.int64()),
    ("step_group", pa.int64()),
)


def crc32(ids: np.ndarray) -> int:
    """Of the ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class TierPacker:
    """Packs the documents of one task. ``rows`` holds finished pieces until they are taken."""

    def __init__(self, task: int = 0, tiers: tuple[int, ...] = TIERS, block: int = BLOCK, step: int = STEP) -> None:
        self.tiers, self.window, self.block, self.step = tiers, tiers[0], block, step
        self.next_sequence = self.next_step = task << _TASK_BITS
        self.rests: list[tuple] = []  # (number of ids, order, key, start, ids, tokens of the document)
        self.order = 0
        self.rows: list[tuple] = []
        self.open: dict[int, list[list[tuple]]] = {}  # windows by size that wait for a step group

    def add(self, key, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._put([(key, start, ids[start : start + self.window], n)])
        if whole < n:
            self._rest(self.rests, key, whole, ids[whole:], n)
            if len(self.rests) >= self.block:
                self.pack()

    def _rest(self, into: list, key, start: int, ids: np.ndarray, n: int) -> None:
        self.order += 1
        rest = (len(ids), self.order, key, start, ids.copy() if into is self.rests else ids, n)
        into.append(rest) if into is self.rests else insort(into, rest, key=lambda r: r[:2])

    def _put(self, pieces: list[tuple]) -> None:
        """One full window of pieces (key, start, ids, tokens of the document)."""
        rows, offset = [], 0
        for key, start, ids, n in pieces:
            rows.append((key, start, len(ids), crc32(ids), n, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1
        held = self.open.setdefault(offset, [])
        held.append(rows)
        if len(held) * offset >= self.step:
            self._close(held)
            del self.open[offset]

    def _close(self, windows: list[list[tuple]]) -> None:
        for rows in windows:
            size = sum(r[2] for r in rows)
            self.rows += [(*r, size, self.next_step) for r in rows]
        self.next_step += 1

    def pack(self) -> None:
        """Fill windows from the rests that wait; what fills no window waits on."""
        pools: dict[int, list[tuple]] = {}
        for rest in sorted(self.rests, key=lambda r: r[:2]):
            pools.setdefault(min(t for t in self.tiers if t >= rest[0]), []).append(rest)
        left: list[tuple] = []
        for k, tier in enumerate(self.tiers):
            own = pools.get(tier, [])
            shorter = [t for t in self.tiers[k + 1 :] if pools.get(t)]
            while own:
                head = own.pop()
                pieces, gap = [head[2:]], tier - head[0]
                while gap:
                    shorter = [t for t in shorter if pools[t]]
                    # The last tier has no shorter one and takes short rests of its own.
                    near = [*shorter, tier] if own else shorter
                    fit = next((t for t in near if pools[t][0][0] <= gap), None)
                    if fit is not None:
                        at = bisect_right(pools[fit], gap, key=lambda r: r[0]) - 1
                        taken = pools[fit].pop(at)
                    elif shorter or own:  # cut the shortest one there is
                        pool = pools[shorter[-1]] if shorter else own
                        size, _, key, start, ids, n = pool.pop(0)
                        taken = (gap, 0, key, start, ids[:gap], n)
                        rest_tier = min(t for t in self.tiers if t >= size - gap)
                        self._rest(pools.setdefault(rest_tier, []), key, start + gap, ids[gap:], n)
                        if rest_tier < tier and rest_tier not in shorter:
                            shorter = sorted([*shorter, rest_tier], reverse=True)
                    else:
                        break
                    pieces.append(taken[2:])
                    gap -= taken[0]
                if gap:
                    left += [(len(p[2]), 0, *p) for p in pieces]
                else:
                    self._put(pieces)
        self.rests = left

    def finish(self) -> None:
        """Pack all that waits; the last less than a window goes out in falling powers of two."""
        self.pack()
        queue = deque(r[2:] for r in self.rests)
        self.rests = []
        total = sum(len(p[2]) for p in queue)
        while total:
            size = min(self.window, 1 << (total.bit_length() - 1))
            total -= size
            pieces, gap = [], size
            while gap:
                key, start, ids, n = queue.popleft()
                pieces.append((key, start, ids[:gap], n))
                if len(ids) > gap:
                    queue.appendleft((key, start + gap, ids[gap:], n))
                gap -= min(gap, len(ids))
            self._put(pieces)
        last: list[list[tuple]] = []
        held = 0
        for size in sorted(self.open, reverse=True):
            for rows in self.open[size]:
                if held + size > self.step:
                    self._close(last)
                    last, held = [], 0
                last.append(rows)
                held += size
        if last:
            self._close(last)
        self.open = {}


def pack_documents(
    docs: DataFrame,
    path: str = public_tokenizers.path("byte_bpe_50k.json"),
    tiers: tuple[int, ...] = TIERS,
    separator: int = SEPARATOR,
    block: int = BLOCK,
    step: int = STEP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document in a packed sequence.

    A document is the ids of its whole text (null: empty) and then ``separator``. Each id lies in exactly one
    piece: ``start`` ids of the document are before it, ``length`` in it. ``sequence_id`` and ``offset`` say
    where it lies; ``tier`` is the length of the full sequence, a power of two; ``step_group`` numbers groups
    of sequences of at most ``step`` tokens. Repeated rows and rows with a null id
    are documents of their own; no rows give none. Other columns are not passed on.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers are powers of two, the largest first")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library(path)
        packer = TierPacker(TaskContext.get().partitionId(), tiers, block, step)
        last = np.array([separator], np.int32)
        key_type = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * (len(COLUMNS) + 1)
            packer.rows = []
            arrays = [pa.array(columns[0], key_type)]
            arrays += [pa.array(c, t) for c, (_, t) in zip(columns[1:], COLUMNS)]
            return pa.RecordBatch.from_arrays(arrays, [id_col, *(name for name, _ in COLUMNS)])

        for keys, texts in text_rows(batches):
            key_type = keys.type
            held: list[list[np.ndarray]] = [[] for _ in texts]
            for i, piece in tokens.ids(texts):
                held[i].append(piece)
            for key, ids in zip(keys.to_pylist(), held):
                packer.add(key, np.concatenate([*ids, last]))
            if len(packer.rows) >= 4096:
                yield out()
        if key_type is not None:
            packer.finish()
            yield out()

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{name} bigint" for name, _ in COLUMNS)
    return docs.select(id_col, text_col).mapInArrow(run, schema)

"""Byte-level BPE by ranks: a segment tree over byte positions finds the next merge.

Leaf i of a pre-token's tree holds the rank of the pair that starts at byte i, or no pair where no token
starts there or the pair is no token. An inner node holds the least rank below it and, among equal ranks,
the leftmost position; both lie in one integer, so a node is the minimum of its children. The root is the
next merge. A merge changes three leaves (the pair itself, the pair before it, the start that is gone),
each updated along its path: O(log n) per merge, O(n log n) for a pre-token of n bytes.

Many pre-tokens of about equal length are worked on together as one array of trees. Where there are few of a length,
long ones above all, each is a tree of plain integers: its updates end where a node keeps its value.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from millrace.llm.encoding import CachedEncoder, once_per_worker, text_rows
from millrace.llm.pretokens import HashTable, _mixed

NONE = np.iinfo(np.int64).max
# Leaves that are worked on together.
LEAVES = 1 << 19
# Fewer pre-tokens than this are not worth arrays of trees.
FEW = 24


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankEncoder:
    """Pre-tokens to ids by a rank file, and ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = _mixed(np.fromiter(pairs, np.uint64, len(pairs)) + np.uint64(1))
        self.pairs = HashTable(max(2, int(len(pairs)).bit_length() + 1))
        self.pairs.add(keys, np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.rank_of = pairs

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where the two together are no token."""
        keys = _mixed((left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1))
        return self.pairs.find(keys)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in texts]
        found: list[np.ndarray | None] = [None] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(raw):
            whole = self.ranks.get(word)
            if whole is not None:
                found[i] = np.array([whole], np.int32)
            else:
                groups.setdefault(max(2, (len(word) - 1).bit_length()), []).append(i)
        for bits, members in groups.items():
            at_once = max(1, LEAVES >> bits)
            for first in range(0, len(members), at_once):
                part = members[first : first + at_once]
                few = len(part) < FEW
                words = [raw[i] for i in part]
                for i, ids in zip(part, map(self._merged_alone, words) if few else self._merged(words, bits)):
                    found[i] = ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate(found) if found else np.zeros(0, np.int32), counts

    def _merged(self, words: list[bytes], bits: int) -> list[np.ndarray]:
        """Ids of words of at most 2**bits bytes, each of more than 2**(bits - 1) bytes unless bits is 2."""
        n, m = len(words), 1 << bits
        sizes = np.fromiter(map(len, words), np.int64, n)
        here = np.arange(m)
        inside = here < sizes[:, None]
        token = np.zeros((n, m + 1), np.int64)
        token[:, :m][inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(here + 1, sizes[:, None])
        before = np.broadcast_to(here - 1, (n, m)).copy()
        live = inside.copy()
        tree = np.full((n, 2 * m), NONE)
        pair = here + 1 < sizes[:, None]
        rank = self.pair_ranks(token[:, :m][pair], token[:, 1:][pair]).astype(np.int64)
        tree[:, m:][pair] = np.where(rank < 0, NONE, rank << bits | np.broadcast_to(here, (n, m))[pair])
        for level in range(bits - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])

        nodes = tree.reshape(-1)  # one index instead of two is faster

        def put(rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
            root, node = rows * (2 * m), places + m
            nodes[root + node] = values
            for _ in range(bits):
                node >>= 1
                low = root + 2 * node
                nodes[root + node] = np.minimum(nodes[low], nodes[low + 1])

        def pair_value(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
            right = after[rows, places]
            found = self.pair_ranks(token[rows, places], token[rows, right]).astype(np.int64)
            return np.where((right >= sizes[rows]) | (found < 0), NONE, found << bits | places)

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            top = tree[rows, 1]
            place = top & (m - 1)
            gone = after[rows, place]
            behind = after[rows, gone]
            token[rows, place] = top >> bits
            after[rows, place] = behind
            live[rows, gone] = False
            more = behind < sizes[rows]
            before[rows[more], behind[more]] = place[more]
            put(rows, gone, np.full(len(rows), NONE))
            put(rows, place, pair_value(rows, place))
            ahead = before[rows, place]
            has = ahead >= 0
            put(rows[has], ahead[has], pair_value(rows[has], ahead[has]))
            rows = rows[tree[rows, 1] != NONE]
        flat = token[:, :m][live].astype(np.int32)
        return np.split(flat, np.cumsum(live.sum(axis=1))[:-1])

    def _merged_alone(self, word: bytes) -> np.ndarray:
        """Ids of one word of two bytes or more."""
        size = len(word)
        bits = (size - 1).bit_length()
        m = 1 << bits
        first = self.of_byte[np.frombuffer(word, np.uint8)]
        rank = self.pair_ranks(first[:-1], first[1:]).astype(np.int64)
        levels = [np.full(m, NONE)]
        levels[0][: size - 1] = np.where(rank < 0, NONE, rank << bits | np.arange(size - 1))
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        # Node 1 is the root, the children of node i are 2 * i and 2 * i + 1.
        tree = array("q", np.concatenate([[NONE], *reversed(levels)]).astype(np.int64).tobytes())
        token = array("q", first.tobytes())
        after, before = array("q", range(1, size + 1)), array("q", range(-1, size - 1))
        rank_of = self.rank_of.get

        def put(place: int, value: int) -> None:
            node = place + m
            tree[node] = value
            while node > 1:
                beside = tree[node ^ 1]
                if beside < value:
                    value = beside
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        def pair_value(place: int, right: int) -> int:
            found = rank_of(token[place] << 32 | token[right])
            return NONE if found is None else found << bits | place

        while (top := tree[1]) != NONE:
            place = top & (m - 1)
            gone = after[place]
            behind = after[gone]
            token[place] = top >> bits
            token[gone] = -1
            after[place] = behind
            put(gone, NONE)
            if behind < size:
                before[behind] = place
                put(place, pair_value(place, behind))
            else:
                put(place, NONE)
            ahead = before[place]
            if ahead >= 0:
                put(ahead, pair_value(ahead, place))
        left = np.frombuffer(token, np.int64)
        return left[left >= 0].astype(np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def local_copy(path: str) -> str:
    """The file where it lies on this machine, else the copy that was sent along with the job."""
    try:
        with open(path, "rb"):
            return path
    except FileNotFoundError:
        return SparkFiles.get(path.rsplit("/", 1)[-1])


def encoder(path: str) -> tuple[RankEncoder, CachedEncoder]:
    """The worker's encoder of a rank file."""

    def make() -> tuple[RankEncoder, CachedEncoder]:
        ranks = RankEncoder(read_ranks(local_copy(path)))
        return ranks, CachedEncoder(ranks)

    return once_per_worker(("ranks", path), make)


def encode_texts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>``: ids of every whole text; special tokens are ordinary text.

    A null text is an empty one and has no ids. Rows are kept as they come, repeated ones and ones with a
    null id too. Other columns are not passed on, so their names do not matter. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cached = encoder(ranks_path)
        for keys, texts in text_rows(batches):
            ids: list[list[np.ndarray]] = [[] for _ in texts]
            for i, piece in cached.ids(texts):
                ids[i].append(piece)
            lists = [np.concatenate(p) if p else np.zeros(0, np.int32) for p in ids]
            yield pa.RecordBatch.from_arrays([keys, pa.array(lists, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, bytes``: the bytes that a list of ids stands for. Null ids give null, no ids no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = encoder(ranks_path)
        for batch in batches:
            raw = [None if ids is None else ranks.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip_digests(
    docs: DataFrame,
    ranks_path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded in one pass.

    The digests are of the ids in decimal, joined by commas, and of the bytes that the ids give again. They
    are fed piece by piece, so a very long text needs no copy of all its ids. A null or empty text has no
    tokens and the digests of nothing. Repeated rows give equal rows; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cached = encoder(ranks_path)
        names = {rank: str(rank) for rank in ranks.tokens}
        for keys, texts in text_rows(batches):
            counts = [0] * len(texts)
            listed = [hashlib.sha256() for _ in texts]
            decoded = [hashlib.sha256() for _ in texts]
            for i, piece in cached.ids(texts):
                ids = piece.tolist()
                line = ",".join(map(names.__getitem__, ids))
                listed[i].update((f",{line}" if counts[i] else line).encode())
                decoded[i].update(ranks.decode(ids))
                counts[i] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(counts, pa.int64()),
                    pa.array([h.hexdigest() for h in listed]),
                    pa.array([h.hexdigest() for h in decoded]),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

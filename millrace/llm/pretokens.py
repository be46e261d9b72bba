"""Pre-tokens of many texts at once, as numpy arrays, and a bounded table keyed by their hashes.

The pattern of ``public_tokenizers.PATTERN`` is a rule over runs of four character classes (letters,
numbers, white space, the rest), so its matches are found from class changes:

* a run of one class is a match, and a plain space in front of a run of another class belongs to it;
* of white space in front of other text, the last character is set apart; at the end of a text it is not;
* ``'s 't 'm 'd 're 've 'll`` are matches where the apostrophe is not part of a longer match.

A pre-token is known by a 64-bit hash of its characters. Among a million different pre-tokens of one
worker's table, two share a hash with a probability of about 3 in 100 million.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import pre_tokenizers

# Class numbers; END stands between texts.
LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
END_POINT = 0x110000
# Characters that are worked on together. Longer texts are cut where no match can span the cut.
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kinds() -> np.ndarray:
    """Class of every code point.

    Versions of Unicode differ in which points are assigned. Where two of them disagree, the tokenizer
    library itself is asked: a point is a letter if it holds together with letters.
    """
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, END_POINT)]))
    kinds = np.full(END_POINT + 1, OTHER, np.uint8)
    for kind, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.findall(rule, points):
            kinds[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in points:
        at, older = ord(c), {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)
        if kinds[at] != older and kinds[at] != SPACE:
            letter, number = len(split(f"a{c}b")) == 1, len(split(f"1{c}2")) == 1
            kinds[at] = LETTER if letter else NUMBER if number else OTHER
    kinds[END_POINT] = END
    return kinds


class Splitter:
    """Splits chunks of texts into pre-tokens. One per worker: it holds tables over all code points."""

    def __init__(self) -> None:
        self.kinds = _kinds()
        self.mix = _mixed(np.arange(1, END_POINT + 2, dtype=np.uint64) * _BASE)
        self._grow(CHUNK + 4096)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(n, _BASE), dtype=np.uint64)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.inverses = np.cumprod(np.full(n, inverse), dtype=np.uint64)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``points, starts, ends, hashes, owner``: pre-token i is points[starts[i]:ends[i]] of texts[owner[i]]."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.concatenate([[1], np.cumsum(sizes + 1) + 1])  # a mark before, between and after
        points = np.full(int(firsts[-1]) + 1, END_POINT, np.uint32)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = 0
        for first, size in zip(firsts.tolist(), sizes.tolist()):
            points[first : first + size] = flat[at : at + size]
            at += size
        kinds = self.kinds[points]
        start = np.empty(len(points), bool)
        start[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
        space = kinds == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & (kinds[1:] != END))
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        self._contractions(points, kinds, start)
        bounds = np.flatnonzero(start)
        real = np.flatnonzero(kinds[bounds] != END)
        starts, ends = bounds[real], bounds[real + 1]
        if len(points) > len(self.powers):
            self._grow(len(points))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(self.mix[points] * self.powers[: len(points)], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
            hashes = _mixed(hashes + (ends - starts).astype(np.uint64))
        hashes |= np.uint64(hashes.size == 0)  # keeps the type for no rows
        hashes[hashes == 0] = 1  # 0 marks a free slot
        owner = np.searchsorted(firsts, starts, side="right") - 1
        return points, starts, ends, hashes, owner

    @staticmethod
    def _contractions(points: np.ndarray, kinds: np.ndarray, start: np.ndarray) -> None:
        marks = np.flatnonzero((points == 0x27) & start)
        if not len(marks):
            return
        one, two = points[marks + 1], points[np.minimum(marks + 2, len(points) - 1)]
        letter = kinds[marks + 1] == LETTER
        short = letter & np.isin(one, [ord(c) for c in "stmd"])
        long = letter & (
            ((one == ord("r")) & (two == ord("e")))
            | ((one == ord("v")) & (two == ord("e")))
            | ((one == ord("l")) & (two == ord("l")))
        )
        start[marks[short | long] + 1] = False
        start[marks[short] + 2] = True
        start[marks[long] + 3] = True


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in pieces of about ``size`` characters whose pre-tokens together are those of the text.

    A cut is made only at a plain space behind a character that is no white space: a match always starts
    there, and what stands before it ends in no white space. A text without such a place stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    if at < len(text) or not text:
        yield text[at:]


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in lists of about ``size`` characters, with the number of the text each piece is from."""
    held: list[str] = []
    owner: list[int] = []
    n = 0
    for i, text in enumerate(texts):
        for piece in pieces(text, size) if len(text) > size else (text,):
            held.append(piece)
            owner.append(i)
            n += len(piece) + 1
            if n >= size:
                yield held, owner
                held, owner, n = [], [], 0
    if held:
        yield held, owner


class HashTable:
    """Open addressing over 64-bit keys, searched and filled by whole arrays; values are row numbers."""

    def __init__(self, bits: int) -> None:
        self.bits, self.limit, self.size = bits, 1 << (bits - 1), 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where it is not held."""
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        mask = (1 << self.bits) - 1
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in keys that are all different and not held yet."""
        todo, slot = np.arange(len(keys)), self._slots(keys)
        mask = (1 << self.bits) - 1
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.values[slot[won]] = values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & mask
        self.size += len(keys)

"""Pre-tokens by the tokenizers library, and texts cut at its added tokens."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np

from millrace.llm.byte_bpe import local_copy
from millrace.llm.encoding import CachedEncoder, once_per_worker


class LibraryTokens:
    """A byte-level BPE file of the tokenizers library, by pre-tokens.

    Its added tokens are found in the text first, as the library does, and the text between two of them is
    split for itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = local_copy(path)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level files without normalizer and prefix space")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take white space or word bounds along")
        self.added = {t["content"]: t["id"] for t in added}
        self.cached = CachedEncoder(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts

    def parts(self, text: str) -> list[str | int]:
        """Text between added tokens, and the ids of these, in order."""
        out: list[str | int] = [text]
        for token in sorted(self.added, key=len, reverse=True):
            cut: list[str | int] = []
            for part in out:
                if isinstance(part, str) and token in part:
                    for i, between in enumerate(part.split(token)):
                        cut += [self.added[token], between] if i else [between]
                else:
                    cut.append(part)
            out = cut
        return out

    def ids(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """As ``CachedEncoder.ids``, added tokens included."""
        plain: list[str] = []
        owner: list[int] = []
        marks: list[list[int]] = []  # ids of added tokens in front of the plain part
        for i, text in enumerate(texts):
            before: list[int] = []
            for part in self.parts(text):
                if isinstance(part, int):
                    before.append(part)
                else:
                    plain.append(part)
                    owner.append(i)
                    marks.append(before)
                    before = []
        if not any(marks):
            yield from self.cached.ids(texts)
            return
        at = 0
        for piece, ids in self.cached.ids(plain):
            for k in range(at, piece + 1):
                if marks[k]:
                    yield owner[k], np.array(marks[k], np.int32)
            at = max(at, piece + 1)
            yield owner[piece], ids
        for k in range(at, len(plain)):
            if marks[k]:
                yield owner[k], np.array(marks[k], np.int32)


def library(path: str) -> LibraryTokens:
    """The worker's tokens of a file."""
    return once_per_worker(("library", path), lambda: LibraryTokens(path))

"""Pre-tokens of byte-level BPE files, and their pieces by the tokenizers library.

In this scheme a pre-token always begins at a blank that a visible character follows. So a text is parted at
such blanks, each distinct chunk is worked out once per worker, and the rest is a table look-up. Texts with runs of
blanks or with special tokens inside take the plain path through the whole pattern.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import Memo, coded, kept, spliced, strings

# Fixed value: the pre-token pattern of these files; blanks are those with the White_Space property.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
RUNS = re.compile(r" (?=\s|$)")
ODD = r" (?:[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"  # the same for Arrow


def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
    from tokenizers import Tokenizer

    return kept("tokenizer", path, lambda: Tokenizer.from_file(path))


def piece_ids(path: str, words: list[str]) -> list[list[int]]:
    return [e.ids for e in library(path).encode_batch_fast(words, add_special_tokens=False)]


def special_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in library(path).get_added_tokens_decoder().items()}


def stretches(text: str, special: dict[str, int]) -> list[str]:
    """The text parted at special tokens, which stay as entries of their own."""
    if not any(s in text for s in special):
        return [text]
    names = sorted(special, key=len, reverse=True)
    return [t for t in regex.split("(" + "|".join(map(regex.escape, names)) + ")", text) if t]


class ChunkTable:
    """Texts to ``int32`` codes by ``make(chunk) -> bytes``; ``single(token)`` codes a special token."""

    def __init__(self, path: str, make, single):
        self.special = special_tokens(path)
        self.single = single
        self.chunks = Memo(lambda c: make(" " + c), 250_000)
        self.make = lambda c: make(c) if c else b""

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.make, PIECES.findall(text)))

    def codes(self, text: str) -> bytes:
        parts = stretches(text, self.special)
        if len(parts) > 1 or parts[0] in self.special:
            return b"".join(self.single(p) if p in self.special else self.codes(p) for p in parts)
        if RUNS.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.make(first) + b"".join(map(self.chunks.__getitem__, rest))

    def all_codes(self, column: pa.Array, make_all=None) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all texts, codes per text) of a string column."""
        column = strings(column)
        odd = pc.match_substring_regex(column, ODD)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(column, name))
        apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        extra = [self.codes(t) for t in column.take(pa.array(apart)).to_pylist()]
        usual = column.filter(pc.invert(odd)) if len(apart) else column
        known = self.chunks

        def look_up(chunks: list[str]) -> list[bytes]:
            return list(map(known.__getitem__, chunks)) if make_all is None else known.many(chunks, make_all)

        flat, sizes = coded(pc.split_pattern(usual, " "), look_up, lambda firsts: list(map(self.make, firsts)))
        return spliced(flat, sizes, apart, extra)


def _coder(path: str) -> ChunkTable:
    lib, special = library(path), special_tokens(path)
    return ChunkTable(
        path, lambda chunk: np.array(lib.encode(chunk, add_special_tokens=False).ids, np.int32).tobytes(),
        lambda token: np.array([special[token]], np.int32).tobytes())


def encode_all(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids per text): chunks not seen before go to the library in one batch."""
    return kept("chunk ids", path, lambda: _coder(path)).all_codes(column, lambda new: [
        array("i", ids).tobytes() for at in range(0, len(new), 50_000)
        for ids in piece_ids(path, [" " + c for c in new[at : at + 50_000]])])

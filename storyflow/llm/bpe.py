"""BPE encoding and decoding over a contiguous rank array.

A word is held as its part boundaries, the id of each part and, next to them, the rank of joining each part
with its right neighbour. The least rank is found by scanning the array, its boundary is deleted and the two
neighbouring ranks are looked up anew. Words are short, so a scan of a small list beats any tree; words over
``SHORT`` parts (texts without blanks) go through a heap with the same result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Memo, coded, forget, int_lists, kept, slices, spliced, strings, tidy, trimmed

SHORT = 100  # parts; longer words go through the heap
SLICE = 2 << 20  # bytes of text encoded at once; a longer text is a slice of its own
TOKENS = 1 << 18  # tokens decoded at once; a longer list is a slice of its own
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    table = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Ranks:
    """Merge ranks and ids of a tokenizer file with ``model.vocab`` and ``model.merges``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = [vocab.get(s) for s in byte_symbols()]
        self.last_ids = [vocab.get(s + self.suffix) for s in byte_symbols()]
        self.gaps = None in self.byte_ids or None in self.last_ids
        self.pairs: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.pairs[vocab[a], vocab[b]] = rank
            self.joined.append(vocab[a + b])
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = list(map(self.byte_ids.__getitem__, raw))
        if self.suffix and raw:
            ids[-1] = self.last_ids[raw[-1]]
        return [i for i in ids if i is not None] if self.gaps else ids

    def parts(self, word: str) -> list[int]:
        ids = self.symbols(word)
        if len(ids) < 2:
            return ids
        return self._scan(ids)[0] if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """(ids, boundaries) of the parts that are left when no neighbours can be joined."""
        pairs, joined = self.pairs, self.joined
        bounds = list(range(len(ids)))
        ranks = [pairs.get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            k = ranks.index(least)
            ids[k] = joined[least]
            del ids[k + 1], bounds[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = pairs.get((ids[k], ids[k + 1]), NEVER)
            if k:
                ranks[k - 1] = pairs.get((ids[k - 1], ids[k]), NEVER)
        return ids, bounds

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.pairs[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or self.pairs.get((ids[k], ids[j])) != rank:
                continue
            ids[k], ids[j] = self.joined[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := self.pairs.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(queue, (r, a))
        return [i for i in ids if i >= 0]


class WordEncoder:
    """Texts to ids for files whose words are letters, single digits or marks and whose blanks are dropped.

    White space always parts words, so a text is split there first and each distinct chunk is worked out once.
    A chunk may hold rarer blanks: the pattern finds them.
    """

    # Contractions and word classes of the file's own pattern.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.words = Memo(lambda w: array("i", ranks.parts(w)).tobytes(), 60_000)
        self.chunks = Memo(self.stretch, 60_000)
        names = sorted(ranks.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def stretch(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.ranks.lower:
            text = text.replace("Σ", "σ").lower()  # the library lowers each letter by itself, also a last sigma
        return b"".join(map(self.words.__getitem__, self.WORDS.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, 4 bytes each."""
        parts = self.specials.split(text) if self.specials else [text]
        return b"".join(
            array("i", [self.ranks.special[part]]).tobytes() if part in self.ranks.special else self.stretch(part) for part in parts)

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text) of a string column; texts with special tokens are coded apart."""
        column = strings(column)
        odd = np.zeros(len(column), bool)
        for name in self.ranks.special:
            odd |= pc.match_substring(column, name).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(odd)
        extra = [self.encode(t) for t in column.take(pa.array(apart)).to_pylist()]
        usual = column.filter(pa.array(~odd)) if len(apart) else column
        flat, sizes = coded(pc.ascii_split_whitespace(usual), lambda chunks: list(map(self.chunks.__getitem__, chunks)))
        return spliced(flat, sizes, apart, extra)


def encoder(path: str) -> WordEncoder:
    return kept("word encoder", path, lambda: WordEncoder(Ranks(path)))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``ids``, the array of token ids of the whole text.

    Null and empty texts give an empty array; texts of any length are taken whole; repeated rows stay, each with
    its ids; strings of special tokens inside a text become those tokens. Other columns are left out, so their
    names cannot clash. The tokenizer file must be at ``path`` on every executor.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = T.StructType([*rows.drop("__text").schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("word encoder", "token names")
        enc = encoder(path)
        for batch in slices(batches, "__text", SLICE):
            lists = int_lists(*enc.encode_all(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), lists], names=[*keep, ids])
            del lists
            trimmed()

    return rows.mapInArrow(tidy(run), out)


def _names(path: str) -> pa.Array:
    return kept("token names", path, lambda: pa.array(Ranks(path).names))


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that the lists of ``column`` hold about ``limit`` tokens, however many rows a batch has."""
    for batch in batches:
        at, start = batch.column(column).offsets.to_numpy(), 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(at, at[start] + limit, side="right")) - 1, start + 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the names of the tokens in ``ids``, special ones too, parted by one blank, as a file
    without decoder prescribes. A null or empty array gives the empty text; ids outside the file give nothing.
    """
    out = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType(), False)])
    columns = docs.columns

    def joined(lists: pa.ListArray, names: pa.Array) -> pa.Array:
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
        flat, at = lists.flatten(), lists.offsets.to_numpy()
        good = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names)))
        if flat.null_count or not pc.all(good).as_py():
            lists = pa.array([[i for i in x if i is not None and 0 <= i < len(names)] for x in lists.to_pylist()], pa.list_(pa.int32()))
            flat, at = lists.flatten(), lists.offsets.to_numpy()
        words = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), names.take(flat)) if len(flat) else None
        return pc.binary_join(words, " ") if words is not None else pa.array([""] * len(lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("word encoder", "token names")
        names = _names(path)
        for batch in _slices(batches, ids):
            yield pa.RecordBatch.from_arrays([*batch.columns, joined(batch.column(ids), names)], names=[*columns, text])
            trimmed()

    return docs.mapInArrow(tidy(run), out)

"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. A task reads documents in blocks of ``BLOCK_BYTES`` and counts the pre-tokens of each. A pre-token that is a
   vocabulary entry of one piece needs no look-up; for every other distinct pre-token the block gives one row with
   its postings (place of the document in the block, frequency).
2. These rows meet by pre-token; each distinct one is counted once by the library, and its number of pieces times
   the frequencies goes back as (document, pieces).
3. The sum over a document's rows is its number of tokens.

A pre-token found in many documents of a block is joined with its count block by block instead of in one place,
so no key gathers more than a block's postings a row and the most frequent ones are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .byte_pieces import PIECES, ChunkTable, library, piece_ids
from .common import bytes_of, kept, mixed, slices, trimmed

BLOCK_BYTES = 32 << 20  # of text; one block's postings are in a task's memory at once
HOT = 64  # documents of a block with a pre-token, from which on its rows are not brought together
NAMES = 300_000  # distinct pre-tokens a worker numbers before it starts anew
FREQ_BITS = 12


class Numbering:
    """Texts to numbers of their pre-tokens: 0 for one that is a single known piece, else a place in ``names``."""

    def __init__(self, path: str):
        lib = library(path)
        entries = [lib.decode([i], skip_special_tokens=False) for i in range(lib.get_vocab_size())]
        entries = [e for e in entries if e and "�" not in e]
        self.single = {e for e, ids in zip(entries, piece_ids(path, entries)) if len(ids) == 1}
        self.path = path
        self.restart()

    def restart(self) -> None:
        self.names: list[str] = [""]
        self.numbers: dict[str, int] = {}
        self.table = ChunkTable(self.path, self.chunk, lambda token: bytes(4))

    def number(self, word: str) -> int:
        if word in self.single:
            return 0
        got = self.numbers.get(word)
        if got is None:
            got = self.numbers[word] = len(self.names)
            self.names.append(word)
        return got

    def chunk(self, chunk: str) -> bytes:
        return np.array([self.number(w) for w in PIECES.findall(chunk)], np.int32).tobytes()


def numbering(path: str) -> Numbering:
    return kept("numbering", path, lambda: Numbering(path))


def _postings(numbers: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct numbers, postings per number, packed postings): place above, frequency in the low bits."""
    keys, freq = np.unique((numbers.astype(np.int64) << 32) | places, return_counts=True)
    top = (1 << FREQ_BITS) - 1
    more = -(-freq // top)  # a frequency too large for its bits goes in several postings
    keys, left = np.repeat(keys, more), np.repeat(freq, more)
    nth = np.arange(len(keys)) - np.repeat(np.cumsum(more) - more, more)
    packed = ((keys & 0xFFFFFFFF) << FREQ_BITS) | np.minimum(left - nth * top, top)
    found, sizes = np.unique(keys >> 32, return_counts=True)
    return found, sizes, packed.astype("<u4")


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row, as the tokenizer file at ``path`` counts.

    Null and empty texts have 0 of both; repeated rows stay rows of their own; an empty table gives no rows. Special
    strings inside a text count as one token each. Columns not in ``keep`` are left out.
    """
    rows = docs.select(*(F.col(k).alias(f"__{n}") for n, k in enumerate(keep)), F.col(text).alias("__text"))
    kept = [T.StructField(f.name, f.dataType, True) for f in rows.drop("__text").schema.fields]
    names = [f.name for f in kept]
    found = T.StructType([
        T.StructField("pre", T.StringType()), T.StructField("apart", T.LongType()), T.StructField("block", T.LongType()),
        T.StructField("postings", T.BinaryType()), T.StructField("place", T.IntegerType()),
        T.StructField("n_bytes", T.LongType()), T.StructField("n", T.LongType()), *kept])
    parts = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("n_bytes", T.LongType()), *kept])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = numbering(path)
        task = TaskContext.get().partitionId() << 32
        for seq, batch in enumerate(slices(batches, "__text", BLOCK_BYTES)):
            if len(table.names) > NAMES:
                table.restart()
            n, block = batch.num_rows, task + seq
            flat, sizes = table.table.all_codes(batch.column("__text"))
            places = np.repeat(np.arange(n), sizes)
            known = np.bincount(places[flat == 0], minlength=n)
            distinct, lengths, packed = _postings(flat[flat > 0], places[flat > 0])
            m = len(distinct)
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) * 4
            wide = bytes_of(batch.column("__text"))[1]
            words = [table.names[i] for i in distinct.tolist()]
            empty = lambda kind, k: pa.nulls(k, kind)
            for at in range(0, m, 20_000):
                to = min(m, at + 20_000)
                data = packed[ends[at] // 4 : ends[to] // 4].tobytes()
                cut = (ends[at : to + 1] - ends[at]).astype(np.int32)
                k = to - at
                yield pa.RecordBatch.from_arrays([
                    pa.array(words[at:to], pa.string()),
                    pa.array(np.where(lengths[at:to] >= HOT, block + 1, 0)), pa.array(np.full(k, block)),
                    pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data)]),
                    empty(pa.int32(), k), empty(pa.int64(), k), empty(pa.int64(), k),
                    *(empty(batch.column(c).type, k) for c in names)], names=found.names)
            yield pa.RecordBatch.from_arrays([
                empty(pa.string(), n), pa.array(mixed(np.uint64(block) ^ mixed(np.arange(n, dtype=np.uint64))).view(np.int64)), pa.array(np.full(n, block)),
                empty(pa.binary(), n), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(wide)),
                pa.array(known), *(batch.column(c) for c in names)], names=found.names)
            del flat, places, packed, words
            trimmed()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, 0)
        for batch in batches:
            pre = batch.column("pre")
            own = batch.filter(pre.is_null())
            if own.num_rows:
                yield own.select(parts.names)
            rest = batch.filter(pre.is_valid())
            if not rest.num_rows:
                continue
            coded = rest.column("pre").dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w != last[0]]
            pieces = dict(zip(new, map(len, piece_ids(path, new)))) | ({last[0]: last[1]} if last[0] is not None else {})
            last = (words[-1], pieces[words[-1]])
            each = np.array([pieces[w] for w in words])[coded.indices.to_numpy()]
            posts = rest.column("postings")
            at = np.frombuffer(posts.buffers()[1], np.int32)[posts.offset : posts.offset + len(posts) + 1]
            packed = np.frombuffer(posts.buffers()[2], "<u4")[at[0] // 4 : at[-1] // 4].astype(np.int64)
            sizes = np.diff(at) // 4
            block = np.repeat(rest.column("block").to_numpy(), sizes)
            n = (packed & ((1 << FREQ_BITS) - 1)) * np.repeat(each, sizes)
            task, where = np.unique(block, return_inverse=True)
            key, inverse = np.unique((where << 32) | (packed >> FREQ_BITS), return_inverse=True)
            total = np.bincount(inverse, weights=n).astype(np.int64)
            k = len(key)
            yield pa.RecordBatch.from_arrays([
                pa.array(task[key >> 32]), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(total),
                pa.nulls(k, pa.int64()), *(pa.nulls(k, batch.column(c).type) for c in names)], names=parts.names)

    met = rows.mapInArrow(blocks, found).repartition("pre", "apart").sortWithinPartitions("pre")
    sums = met.mapInArrow(counted, parts).groupBy("block", "place").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"),
        *(F.first(c, ignorenulls=True).alias(c) for c in names))
    return sums.select(*(F.col(c).alias(k) for c, k in zip(names, keep)), "n_bytes", "n_tokens")

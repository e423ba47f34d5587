"""Arrow helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

TEXTS = 2_000  # rows with whole texts dealt to a task: Spark sends up to 10,000 at once, and holds them twice on its side of the pipe
SLICE_BYTES = 8 << 20  # texts handled at once inside a task; a longer text is a slice of its own


def kept(name: str, key: str, make: Callable):
    """``make()``, once per Python worker: the functions of this package travel with each task, so what is dear
    to build (a vocabulary, remembered words) is held by the interpreter and outlives the task.
    """
    held = sys.__dict__.setdefault("_storyflow_kept", {})
    if (name, key) not in held:
        held[name, key] = make()
    return held[name, key]


def forget(*but: str) -> None:
    """Let go of what this worker holds under other names: workers outlive a stage, and the next one needs the room."""
    held = sys.__dict__.get("_storyflow_kept", {})
    for name, key in [k for k in held if k[0] not in but]:
        del held[name, key]
    trimmed()


def trimmed() -> None:
    """Give memory that is free in this worker back, so that it is there for the executor's other workers and later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function with this C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives back what it read: idle workers outlive their stage, and neither
    Arrow nor the C library returns the last batch by itself.

    An empty batch comes last, as what writes the results holds on to one, and with it to all that was read at once.
    """
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in run(batches):
            schema = batch.schema
            yield batch
        batch = None
        if schema is not None:
            yield pa.RecordBatch.from_pylist([], schema=schema)
        trimmed()

    return through


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that ``column`` holds about ``limit`` bytes, whatever the length of one text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = np.frombuffer(strings(batch.column(column)).buffers()[1], dtype=np.int64)[: batch.num_rows + 1] if batch.num_rows else None
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def strings(column: pa.Array) -> pa.LargeStringArray:
    """The column with 64-bit offsets that begin at 0, null read as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column, pa.array([], pa.large_string())])
        if column.offset:
            column = pa.array(column.to_pylist(), pa.large_string())
    return column


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets) of a string column without making Python strings."""
    column = strings(column)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[str]:
    return strings(column).to_pylist()


def coded(lists: pa.Array, look_up: Callable[[list[str]], list[bytes]], first: Callable[[list[str]], list[bytes]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(int32 codes of all rows, codes per row) of lists of chunks: ``look_up`` sees each distinct chunk once.

    ``first``, if given, codes the first chunk of each row in place of ``look_up``. No list may be empty then.
    """
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    distinct = flat.dictionary_encode()
    table = look_up(distinct.dictionary.to_pylist())
    index = distinct.indices.to_numpy().astype(np.int64)
    if first is not None:
        index[at[:-1]] = len(table) + np.arange(len(at) - 1)
        table = table + first(flat.take(pa.array(at[:-1])).to_pylist())
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
    blob = np.frombuffer(b"".join(table), np.int32)
    starts = np.cumsum(sizes) - sizes
    here = sizes[index]
    ends = np.cumsum(here)
    out = blob[np.repeat(starts[index] - (ends - here), here) + np.arange(ends[-1] if len(ends) else 0)]
    ends = np.concatenate([[0], ends])
    return out, ends[at[1:]] - ends[at[:-1]]


def spliced(flat: np.ndarray, sizes: np.ndarray, odd: np.ndarray, extra: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Put the rows coded apart (``extra``, at the places ``odd``) back between the others."""
    if not len(odd):
        return flat, sizes
    n = len(sizes) + len(odd)
    parts, all_sizes, done, row = [], np.zeros(n, np.int64), 0, 0
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for k, (place, codes) in enumerate(zip(odd.tolist(), extra)):
        to = place - k
        parts += [flat[done : ends[to]], np.frombuffer(codes, np.int32)]
        all_sizes[row:place] = sizes[to - (place - row) : to]
        all_sizes[place] = len(codes) // 4
        done, row = ends[to], place + 1
    parts.append(flat[done:])
    all_sizes[row:] = sizes[len(sizes) - (n - row) :]
    return np.concatenate(parts), all_sizes


def int_lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a fixed bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """``memo[key]``: the value of ``make(key)``, remembered for the last ``size`` keys at least, twice that at most.

    Two generations: when the young one is full it becomes the old one, and keys still in use move over.
    Long keys are worked out each time, so the memory is bounded. ``many`` may go beyond the size by the keys of one call.
    """

    def __init__(self, make, size: int = 200_000, longest: int = 100):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got

    def many(self, keys: list, make_all) -> list:
        """The values of distinct ``keys``; those not remembered are made in one call of ``make_all(new keys)``."""
        out = list(map(self.get, keys))
        late = [k for k, value in enumerate(out) if value is None]
        if late:
            old = [self.old.get(keys[k]) for k in late]
            made = iter(make_all([keys[k] for k, value in zip(late, old) if value is None]))
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            for k, value in zip(late, old):
                out[k] = next(made) if value is None else value
                if len(keys[k]) <= self.longest:
                    self[keys[k]] = out[k]
        return out

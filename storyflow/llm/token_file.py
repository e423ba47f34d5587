"""Token-ID files: concatenated ids with Elias-Fano encoded document boundaries.

Layout of a segment, little-endian, self-contained:

    "EFTK" | version u16 | id width u16 (2 or 4) | documents u64 | ids u64 | low bits u64 | bytes of high part u64
    ids | low parts, packed | high parts in unary, as a bit vector | place of every 256th set bit, u32 (u64 if large)

Boundary i is where document i ends. Its low bits lie in the packed part, its high bits are the distance of the i-th
set bit from i, so n boundaries up to u take about n * (2 + log2(u / n)) bits in place of 64 n. ``Segment.end(i)``
selects one boundary through the samples; ``Segment.ends()`` gives all at once.

A dataset is a Parquet folder with one segment a row, in ascending document order by (part, seq); Spark's writer
commits it, so a lost task leaves nothing behind and its retry writes the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .byte_pieces import encode_all, library
from .common import slices

HEAD = "<4sHHQQQQ"
SAMPLE = 256
SEGMENT_BYTES = 4 << 20  # of text that goes in one segment; a longer text has a segment of its own
ENCODE_BYTES = 8 << 20  # of text that is encoded at once, so that a chunk is looked up once for several segments
SMALL = 100_000  # parts whose running count is sent to all executors: 2 MB
SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType(), True)), T.StructField("segment", T.BinaryType())])


def low_width(n: int, ids: int) -> int:
    return max(0, (ids // n).bit_length() - 1) if n else 0


def pack(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """A segment of the concatenated ``ids``; ``ends``: where each document ends, not descending."""
    n, total = len(ends), len(ids)
    low = low_width(n, total)
    ends = ends.astype(np.int64)
    lows = ((ends[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    ones = (ends >> low) + np.arange(n)
    bits = np.zeros((total >> low) + n + 1, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4" if len(bits) < 1 << 32 else "<u8")
    head = struct.pack(HEAD, b"EFTK", 1, width, n, total, low, len(high))
    return b"".join((head, ids.astype(f"<u{width}").tobytes(), np.packbits(lows.ravel(), bitorder="little").tobytes(), high, samples.tobytes()))


class Segment:
    """Reads a segment; nothing is copied before it is asked for."""

    def __init__(self, data: bytes):
        mark, version, width, self.n, self.total, self.low, n_high = struct.unpack_from(HEAD, data)
        if mark != b"EFTK" or version != 1:
            raise ValueError("no token segment")
        at = struct.calcsize(HEAD)
        self.ids = np.frombuffer(data, f"<u{width}", self.total, at)
        at += width * self.total
        n_low = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        wide = (self.total >> self.low) + self.n + 1 >= 1 << 32
        self.samples = np.frombuffer(data, "<u8" if wide else "<u4", -(-self.n // SAMPLE), at + n_low + n_high)

    def select(self, i: int) -> int:
        """Place of the i-th set bit of the high part."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = divmod(place, 8)
        while True:
            some = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(some)
            ones = ones[ones >= skip]
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left, byte, skip = left - len(ones), byte + 64, 0

    def end(self, i: int) -> int:
        first = i * self.low
        bits = np.unpackbits(self.lows[first // 8 : (first + self.low + 7) // 8], bitorder="little")[first % 8 :][: self.low]
        return ((self.select(i) - i) << self.low) | int(bits @ (1 << np.arange(self.low)) if self.low else 0)

    def ends(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        ends = (ones - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            ends |= bits @ (1 << np.arange(self.low, dtype=np.int64))
        return ends

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.end(i - 1) if i else 0 : self.end(i)]


def write_tokens(docs: DataFrame, folder: str, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> None:
    """Encode every whole text, append ``end_id`` and write segments in ascending ``doc_id`` order to ``folder``.

    Null doc ids come first; rows with one doc_id go by a digest of their text. Null and empty texts hold the end id
    alone; an empty table makes a folder without segments. Only the two columns are read. Rows are dealt by ranges of
    (doc_id, digest), so even one id with most rows is split.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if max(library(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "text", ENCODE_BYTES):
            flat, sizes = encode_all(path, batch.column("text"))
            ids = np.insert(flat, np.cumsum(sizes), end_id)
            ends = np.concatenate([[0], np.cumsum(sizes + 1)])
            a = 0
            for piece in slices([batch], "text", SEGMENT_BYTES):
                z = a + piece.num_rows
                own = ids[ends[a] : ends[z]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(own)]),
                    pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), pa.concat_arrays([piece.column("id")])),
                    pa.array([pack(own, ends[a + 1 : z + 1] - ends[a], width)], pa.binary())], names=SEGMENT.names)
                seq, before, a = seq + 1, before + len(own), z

    ordered.mapInArrow(run, SEGMENT).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_ids, segment, start) of every segment: ``start`` counts the ids of all segments before it.

    The running count is taken over one row per written part; the segments themselves are not moved while that
    table has up to ``SMALL`` rows, and are joined by part beyond.
    """
    segments = spark.read.schema(SEGMENT).parquet(folder)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if parts.count() <= SMALL:
        before = F.broadcast(before)
    return segments.join(before, "part").select("doc_ids", "segment", (F.col("base") + F.col("offset")).alias("start"))


def documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in rows of ``read_tokens``."""
    out = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.column("segment")[k].as_py())
                ends = segment.ends()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(segment.ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[k].values, pa.array(begins + batch.column("start")[k].as_py()),
                    pa.array(ends - begins), pa.array(sums, pa.int64())], names=out.names)

    return segments.mapInArrow(run, out)

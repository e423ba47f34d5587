"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. On each level runs of one symbol become one symbol; deterministic coin tossing (the place and
value of the lowest bit in which a symbol differs from its left neighbour, repeated until few labels are left)
makes labels that depend on a few neighbours only; phrases begin at local maxima of the labels, and a phrase's name, a
hash of its symbols, is a symbol of the next level. So equal substrings are parsed alike but for their rims, wherever
they stand. The fingerprint keeps the least name of each of ``SLOTS`` classes over the phrases of all levels from
``FIRST`` on, by 16 of its lower bits, which do not shrink as a text grows and its least names do: two fingerprints agree in the share of phrases that their texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import bytes_of, mixed, slices, texts

SLOTS = 64
CLASS_BITS = 6  # lowest bits of a name, its class; the 16 above them are the value
FIRST = 2  # lower levels have phrases of a few letters, which all texts of a language share
EMPTY = 0xFFFF
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)  # no name yet
CELLS = 1 << 16  # buckets of the ids, and of the rows without id, at most, for dealing documents in id order
BUCKET_ROWS = 4096
_SLICE = 1 << 20


def _toss(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labels: twice the lowest place where a symbol differs from its left neighbour, plus its bit there."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[start] = ~x[start]
    differ = x ^ left
    low = differ & (~differ + np.array(1, x.dtype))
    place = (np.frexp(low.astype(np.float64))[1] - 1).astype(x.dtype)
    return (place << np.array(1, x.dtype)) | ((x >> place) & np.array(1, x.dtype))


def _small_tosses() -> np.ndarray:
    """``_toss`` of two bytes as a table."""
    a = np.arange(256)
    differ = a[:, None] ^ a[None, :]
    low = differ & -differ
    place = np.where(low > 0, np.frexp(low.astype(float))[1] - 1, 0)
    return (2 * place + ((a[None, :] >> place) & 1)).astype(np.uint8)


def _labels(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each symbol, never alike for neighbours of one text, and of no other text's making."""
    start = np.flatnonzero(first)
    table = _small_tosses().ravel()
    lab = _toss(x, start).astype(np.uint8)  # below 128
    for _ in range(3):  # below 14, 8, 6
        left = np.empty_like(lab)
        left[1:] = lab[:-1]
        left[start] = lab[start] ^ 1
        lab = table[(left.astype(np.uint16) << 8) | lab]
    for colour in (5, 4, 3):
        at = np.flatnonzero(lab == colour)
        if len(at):
            left = np.where(first[at], 7, lab[at - 1])
            right = np.where(last[at], 7, lab[np.minimum(at + 1, len(lab) - 1)])
            used = (1 << left.astype(np.int64)) | (1 << right.astype(np.int64))
            lab[at] = np.where(used & 1 == 0, 0, np.where(used & 2 == 0, 1, 2))
    return lab


def _level(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of the phrases, offsets of the texts among them)."""
    n = len(x)
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    runs = np.flatnonzero(new)
    length = np.diff(runs, append=n).astype(np.uint64)
    x = x[runs]
    long = length > 1
    x[long] = mixed(x[long] + length[long] * np.uint64(0x9E3779B97F4A7C15))
    start = first[runs]
    last = np.append(start[1:], True)
    lab = _labels(x, start, last)
    higher = np.ones(len(x), bool)
    higher[1:] = lab[1:] > lab[:-1]
    higher[:-1] &= (lab[:-1] > lab[1:]) | last[:-1]
    begins = higher | start
    begins[1:] &= ~start[:-1] | start[1:]  # no phrase of the first symbol alone, unless it is the whole text
    phrase = np.flatnonzero(begins)
    inside = np.arange(len(x)) - np.repeat(phrase, np.diff(phrase, append=len(x)))
    names = mixed(np.add.reduceat(mixed(x + (inside.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)), phrase))
    owner_ends = np.searchsorted(runs, at)
    return names, np.searchsorted(phrase, owner_ends)


def fingerprints(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``SLOTS`` 16-bit values per text; a class without a phrase has ``EMPTY``, an empty text only those."""
    n = len(at) - 1
    x, ends, level = mixed(raw.astype(np.uint64) + np.uint64(1)), at, 0
    least = np.full(n * SLOTS, NONE, np.uint64)
    while len(x):
        x, ends = _level(x, ends)
        level += 1
        size = np.diff(ends)
        whole = size == 1  # a text that has become one phrase: its name counts, and it is done
        use = np.repeat((level >= FIRST) | whole, size)
        owner = np.repeat(np.arange(n), size)
        name = mixed(x[use] + np.uint64(level))
        np.minimum.at(least, owner[use] * SLOTS + (name & np.uint64(SLOTS - 1)).astype(np.int64), name)
        more = np.repeat(~whole, size)
        x, ends = x[more], np.concatenate([[0], np.cumsum(np.where(whole, 0, size))])
    value = np.minimum((least >> np.uint64(CLASS_BITS)) & np.uint64(0xFFFF), EMPTY - 1)
    return np.where(least == NONE, EMPTY, value).astype(np.uint16).reshape(n, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values among the classes that either fingerprint has; 1 if both are empty."""
    either = (a != EMPTY) | (b != EMPTY)
    return np.where(either.any(1), ((a == b) & either).sum(1) / np.maximum(either.sum(1), 1), 1.0)


def hexed(prints: np.ndarray) -> pa.Array:
    data = prints.astype(">u2").tobytes().hex()
    return pa.array([data[k : k + 4 * SLOTS] for k in range(0, len(data), 4 * SLOTS)], pa.string())


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fingerprint") -> DataFrame:
    """``keep`` columns and the fingerprint of every whole text in lower-case hex; equal texts have equal ones.

    Null counts as the empty text, whose fingerprint has no class set. Repeated rows stay; other columns are left out.
    """
    rows = docs.select(*(F.col(k).alias(f"__{n}") for n, k in enumerate(keep)), F.col(text).alias("__text"))
    names = [f"__{n}" for n in range(len(keep))]
    schema = T.StructType([*rows.drop("__text").schema.fields, T.StructField("__print", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", _SLICE):
            found = hexed(fingerprints(*bytes_of(batch.column("__text"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=schema.names)

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(c).alias(k) for c, k in zip(names, keep)), F.col("__print").alias(out))


def marks(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(ids at which buckets of about ``BUCKET_ROWS`` rows begin, not descending; buckets of the rows without id).

    Quantiles of the ids, ``CELLS`` at most, so an id far from the others does not matter; an id that fills several
    buckets is there several times.
    """
    n, named = rows.agg(F.count("*"), F.count("doc_id")).first()
    k = min(CELLS, named // BUCKET_ROWS)
    found = []
    if k:
        shares = ", ".join(f"{j / (k + 1)!r}D" for j in range(1, k + 1))
        found = rows.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 8 * k)})")).first()[0]
    return np.array(found, np.int64), min(CELLS, (n - named) // BUCKET_ROWS) + 1


def bucket_of(none: np.ndarray, ids: np.ndarray, tie: np.ndarray, begins: np.ndarray, nameless: int) -> np.ndarray:
    """Number of the bucket of each row, ascending in (none, id, tie); rows of one id that fills several go by ``tie``."""
    share = (tie >> 32) + (1 << 31)  # a digest, so equal parts of its range hold about equal numbers of rows
    first, last = np.searchsorted(begins, ids, "left"), np.searchsorted(begins, ids, "right")
    inside = np.where(last > first, ((share * (last - first)) >> 32) + 1, 0)
    return np.where(none, len(begins) + 1 + ((share * nameless) >> 32), first + inside)


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, tail, doc_id, text), so that within a bucket each row but the tail is followed by the next document.

    Documents go by id, null last, then by a digest of the text. They are dealt to buckets by quantiles of the ids and, where one id
    or null fills several buckets, by the digest; each bucket also gets the next one's first document as its tail, the last
    one the very first. Equal texts of one id share a bucket. The table broadcast has ``2 * CELLS + 2`` rows at most.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    begins, nameless = marks(rows.select("doc_id"))

    @F.pandas_udf("long")
    def bucket(none: pd.Series, ids: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(none.to_numpy(bool), ids.to_numpy(np.int64), tie.to_numpy(np.int64), begins, nameless))

    keyed = rows.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "tie": F.xxhash64("text")})
    placed = keyed.withColumn("bucket", bucket("none", "id", "tie"))
    buckets = placed.groupBy("bucket").agg(F.min(F.struct("none", "id", "tie")).alias("first"))
    ordered = Window.orderBy("bucket")
    previous = F.coalesce(F.lag("bucket").over(ordered), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    tails = buckets.select("first.*", previous.alias("tail_of"))
    copies = F.array_compact(F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail")),
        F.when(F.col("tail_of").isNotNull(), F.struct(F.col("tail_of").alias("bucket"), F.lit(True).alias("tail")))))
    spread = placed.join(F.broadcast(tails), ["none", "id", "tie"], "left").select(
        "doc_id", "text", "tie", F.explode(copies).alias("c")).select("c.bucket", "c.tail", "doc_id", "tie", "text")
    return spread.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "tie").drop("tie")


EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document, of the document with its second half overwritten by the next one's beginning, and likenesses.

    Rows with null ids are the last documents; rows with one id go by a digest of their text; null texts are empty; the only
    document of a table is its own next; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in slices(batches, "text", _SLICE):
            ids, tail, words = batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist(), texts(batch.column("text"))
            if carried is not None:
                ids, tail, words = [carried[0], *ids], [carried[1], *tail], [carried[2], *words]
            carried = (ids[-1], tail[-1], words[-1])
            own = [k for k in range(len(ids) - 1) if not tail[k]]
            if not own:
                continue
            changed = [words[k][: len(words[k]) - len(words[k]) // 2] + words[k + 1][: len(words[k]) // 2] for k in own]
            prints = fingerprints(*bytes_of(pa.array([*words, *changed], pa.large_string())))
            mine, after, edit = prints[own], prints[[k + 1 for k in own]], prints[len(words) :]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] for k in own], pa.int64()), pa.array([len(words[k]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), hexed(mine), hexed(edit),
                pa.array(likeness(mine, edit)), pa.array(likeness(mine, after))], names=EDITED.names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_order(rows).mapInArrow(run, EDITED)

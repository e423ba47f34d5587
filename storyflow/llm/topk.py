"""Exact top-k by inner product of integer vectors: MaxScore over term-wise postings in shards.

A vector's components are its terms. A shard is a block of candidates; it keeps for each term the postings (candidates with
a component other than 0) and the highest and lowest component. For a query the bound of a term is the most it can
add to a score in this shard, at least 0. Terms are split by these bounds: the non-essential ones cannot lift a
candidate to the k-th best score even together, so only candidates that gain something from an essential term are traversed; the
other terms are probed in order of falling bound while what is left could still make a candidate competitive. The k-th
best score is carried from shard to shard of a task; the tasks' best rows are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..runtime import cut

SHARD = 4096  # candidates of a shard
RUN = 16  # shards in a group, which one task traverses one after another
QUERIES, Q_RUN = 256, 16  # queries scored together, and blocks of them that meet a group of shards at once
PROBES = 8  # terms probed between two looks at which candidates are left
BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()),
                      T.StructField("values", T.BinaryType()), T.StructField("type", T.StringType())])


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or a component is null or not finite."""
    x = F.transform(F.col(vector), lambda v: F.floor(F.lit(scale) * v.cast("double")))
    bad = F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(~bad, x)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(block, ids, values, type): rows of (id, v) packed ``size`` at a time, inside the partitions they are in.

    Shorter vectors are filled with 0, which no posting holds; components take as few bytes as they need.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, held, n
            table = pa.Table.from_batches(held).combine_chunks()
            full = n if last else n // size * size
            for a in range(0, full, size):
                part = table.slice(a, min(size, full - a)).combine_chunks().to_batches()[0]
                lists = part.column("v")
                ends = lists.offsets.to_numpy()
                lengths = np.diff(ends)
                values = np.zeros((part.num_rows, int(lengths.max(initial=0))), np.int64)
                values[np.arange(values.shape[1]) < lengths[:, None]] = lists.values.to_numpy()[ends[0] : ends[-1]]
                kind = np.promote_types(np.min_scalar_type(values.min(initial=0)), np.min_scalar_type(-1 - values.max(initial=0)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([part.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    pa.array([values.astype(kind).tobytes()], pa.binary()), pa.array([kind.name])], names=BLOCK.names)
                block += 1
            held, n = [x for x in table.slice(full).to_batches() if x.num_rows], n - full

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield from packed(False)
        if n:
            yield from packed(True)

    return vectors.select("id", "v").mapInArrow(run, BLOCK)


def unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each block."""
    for ids, values, kind in zip(*(table.column(c).to_pylist() for c in ("ids", "values", "type"))):
        ids = np.frombuffer(ids, np.int64)
        yield ids, np.frombuffer(values, kind).reshape(len(ids), -1).astype(np.int64)


class Shard:
    """Candidates by id, and for each term its highest and lowest component, 0 included."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.high, self.low = vectors.max(0, initial=0), vectors.min(0, initial=0)
        self.peak = int(np.abs(vectors).max(initial=0))

    def competitive(self, q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all pairs that can be among a query's ``k`` best; ``floors``: its k-th score so far.

        Pairs of one id are left out. Sums are taken in doubles where these hold them exactly, else in 64-bit integers.
        """
        width = min(queries.shape[1], self.vectors.shape[1])
        exact = width * self.peak * int(np.abs(queries).max(initial=0)) < 1 << 53
        q, x = queries[:, :width], self.vectors[:, :width]
        if exact:
            q, x = q.astype(np.float64), x.astype(np.float64)
        gain = np.maximum(np.maximum(q * self.high[:width], q * self.low[:width]), 0)
        terms = np.argsort(-gain, axis=1, kind="stable")
        left = np.cumsum(np.take_along_axis(gain, terms, 1)[:, ::-1], 1)[:, ::-1]
        left = np.concatenate([left, np.zeros((len(q), 1), left.dtype)], 1)  # what the terms from here on can add at most
        own = q_ids[:, None] == self.ids
        if np.isneginf(floors).any() and len(self.ids) > k:  # a first floor: the k-th best score of this shard
            new = np.flatnonzero(np.isneginf(floors))
            score = np.where(own[new], -np.inf, q[new] @ x.T)
            floors = floors.copy()
            floors[new] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        needed = (left[:, :-1] >= floors[:, None]).sum(1)  # essential terms
        essential = np.zeros(q.shape, bool)
        np.put_along_axis(essential, terms, np.arange(width) < needed[:, None], 1)
        score = (q * essential) @ x.T
        row, at = np.nonzero((score + left[np.arange(len(q)), needed][:, None] >= floors[:, None]) & ~own)
        score, probed = score[row, at], needed[row]
        while len(row) and (probed < width).any():
            nth = probed[:, None] + np.arange(PROBES)
            some = terms[row[:, None], np.minimum(nth, width - 1)]
            score = score + np.where(nth < width, q[row[:, None], some] * x[at[:, None], some], 0).sum(1)
            probed = np.minimum(probed + PROBES, width)
            good = score + left[row, probed] >= floors[row]
            row, at, score, probed = row[good], at[good], score[good], probed[good]
        return row, at, score.astype(np.int64)


def best_of(q_ids: np.ndarray, queries: np.ndarray, shards: list[Shard], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best candidates of each query in all shards."""
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for shard in shards:
        n = np.bincount(best[0], minlength=len(q_ids))
        floors = np.full(len(q_ids), -np.inf)
        full = n == k
        if full.any():
            last = np.cumsum(n) - 1
            floors[full] = best[2][last[full]]
        row, at, score = shard.competitive(q_ids, queries, floors, k)
        row, ids, score = (np.concatenate(pair) for pair in zip(best, (row, shard.ids[at], score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, np.arange(len(q_ids)))
        good = np.arange(len(row)) - first[row] < k
        best = row[good], ids[good], score[good]
    return best


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query, ties to the smaller id.

    Both tables have (id, v) with arrays of whole numbers; rows with a null id or vector take no part, and a query is
    no candidate of its own id. Repeated rows are candidates each, repeated queries one query. Vectors of unequal
    length are compared as if filled with 0. Sums must fit in 64 bits. Without queries or candidates the result is empty.

    Groups of ``Q_RUN`` query blocks meet groups of ``RUN`` shards by key, so what a task holds is bounded; each side is
    copied once per group of the other, which all queries against all candidates cannot do without.
    """
    full = "id IS NOT NULL AND v IS NOT NULL"
    shards = cut(blocks(vectors.where(full), SHARD))
    asked = cut(blocks(queries.where(full).dropDuplicates(["id"]), QUERIES))
    n_groups, n_asked = max(1, -(-shards.count() // RUN)), max(1, -(-asked.count() // Q_RUN))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = asked.withColumn("q", dealt(n_asked)).withColumn("s", every(n_groups))
    right = shards.withColumn("s", dealt(n_groups)).withColumn("q", every(n_asked))

    def run(key: tuple, some: pa.Table, against: pa.Table) -> pa.Table:
        held = [Shard(*block) for block in unpacked(against)]
        found = [(ids[row], vec, score) for ids, queries in unpacked(some) for row, vec, score in [best_of(ids, queries, held, k)]]
        return pa.table({f.name: pa.array(np.concatenate([x[c] for x in found]) if found else [], pa.int64()) for c, f in enumerate(FOUND.fields)})

    met = left.groupBy("q", "s").cogroup(right.groupBy("q", "s")).applyInArrow(run, FOUND)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

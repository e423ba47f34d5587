"""Ranked lexical search by presence masks.

For an item the documents of a block fall into groups by which of the item's terms they hold: their presence mask. The most a
group can score is the sum, over the terms of its mask, of the most a term adds in the block. Groups come from
bitmaps, one bit a document: beginning with all documents, the group with the highest possible score is split by its next term into
those that hold it and those that do not (two ands), so complete masks come up by falling maximum score, and none is made
that is not needed. A group with all terms decided, or with few documents, is scored in full. The item is finished as soon
as the best group left cannot reach its k-th score, which is carried from block to block.

Terms, weights and lengths are counted over all documents in a first pass, which keeps of a text only its length and the
item terms it holds; the second pass reads that table alone. Items are taken in blocks of bounded vocabulary, a pair of passes each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..runtime import cut
from .common import bytes_of, int_lists, slices

BLOCK_TERMS = 200_000  # item terms searched at once, about: what each task holds as a dictionary
BLOCK, BLOCK_POSTINGS = 8192, 4 << 20  # documents and postings of a block of bitmaps, at most (one document is never split)
GATHER = 8  # blocks sorted by length together, so that a block's documents are of like length and its bounds close
FEW = 48  # documents that are scored at once rather than split further
PIECE = 4 << 20  # bytes of a text whose terms are counted at once

# Terms are maximal runs of ASCII letters and digits and of everything beyond ASCII; only A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, with repeats."""
    return raw.translate(_TABLE).split()


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``raw`` in stretches of about ``size`` bytes that end where a term ends."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and _TABLE[raw[end]] != 32:
            end += 1
        yield raw[at:end]
        at = end


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item, null texts having none."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    out = T.StructType([rows.schema["item_id"], T.StructField("terms", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, at = bytes_of(batch.column("text"))
            found = [sorted({t for p in pieces(raw[a:z].tobytes()) for t in terms_of(p)}) for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=out.names)

    return rows.mapInArrow(run, out)


def held_terms(docs: DataFrame, number: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): the length of each document in terms, and which of the numbered terms it holds how often."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, at = bytes_of(batch.column("text"))
            lengths, sizes, flat, often = [], [], [], []
            for a, z in zip(at, at[1:]):
                seen, n = Counter(), 0
                for p in pieces(raw[a:z].tobytes()):
                    some = terms_of(p)
                    n += len(some)
                    seen.update(map(number.get, some))
                seen.pop(None, None)
                lengths.append(n)
                sizes.append(len(seen))
                flat += seen.keys()
                often += seen.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), int_lists(np.array(flat, np.int32), np.array(sizes)),
                 int_lists(np.array(often, np.int32), np.array(sizes))], names=out.names)

    return rows.mapInArrow(run, out)


class Block:
    """Documents of like length: per term a bitmap and the most it adds, per document its terms and what each adds."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray,
                 weights: np.ndarray, n_docs: int, total: int):
        peak = 90 * int(lengths.max(initial=0)) * n_docs
        n = lengths if peak < 1 << 63 else lengths.astype(object)
        m = (10 + 90 * n * n_docs // max(1, total)).astype(np.int64)
        self.ids, self.terms, self.size = ids, terms, len(ids)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        rows, tf = np.repeat(np.arange(self.size), sizes), tf.astype(np.int64)
        self.adds = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[rows]))
        order = np.argsort(terms, kind="stable")
        edges = np.flatnonzero(np.diff(terms[order], prepend=-1, append=-1)).tolist() if len(terms) else []
        self.bits, self.most = {}, {}
        some = np.zeros(-(-self.size // 8) * 8, np.uint8)
        for a, z in zip(edges, edges[1:]):
            here, term = rows[order[a:z]], int(terms[order[a]])
            most = int(self.adds[order[a:z]].max())
            if most > 0:
                some[here] = 1
                self.bits[term] = int.from_bytes(np.packbits(some, bitorder="little").tobytes(), "little")
                some[here] = 0
                self.most[term] = most

    def documents(self, bits: int) -> np.ndarray:
        """Places of the documents in a bitmap."""
        raw = np.frombuffer(bits.to_bytes(-(-self.size // 8), "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))

    def scores(self, places: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of documents for the item whose terms are flagged in ``asked``."""
        sizes = self.ends[places + 1] - self.ends[places]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.ends[places] - ends + sizes, sizes)
        adds = np.where(asked[self.terms[at]], self.adds[at], 0)
        upto = np.concatenate([[0], np.cumsum(adds)])
        return upto[ends] - upto[ends - sizes]

    def search(self, item: list[int], asked: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids; the first ``k`` by falling score, then rising id) with this block's documents merged in."""
        terms = sorted((t for t in item if t in self.most), key=lambda t: -self.most[t])
        left = [0] * (len(terms) + 1)
        for d in range(len(terms) - 1, -1, -1):
            left[d] = left[d + 1] + self.most[terms[d]]
        scores, ids = best
        floor = int(scores[-1]) if len(scores) == k else 1
        if left[0] < floor:
            return best
        groups = [(-left[0], 0, 0, (1 << self.size) - 1)]  # what a group can score at most, order of entry, terms decided, documents
        entered, waiting = 1, []
        while groups and -groups[0][0] >= floor:
            bound, _, d, bits = heappop(groups)
            if d < len(terms) and bits.bit_count() > FEW:
                held = bits & self.bits[terms[d]]
                if held:
                    heappush(groups, (bound, entered, d + 1, held))
                    entered += 1
                other = bits ^ held
                if other and -bound - self.most[terms[d]] >= floor:
                    heappush(groups, (bound + self.most[terms[d]], entered, d + 1, other))
                    entered += 1
                continue
            places = self.documents(bits)
            score = self.scores(places, asked)
            good = score >= floor
            scores, ids = merged(np.concatenate([scores, score[good]]), np.concatenate([ids, self.ids[places[good]]]), k)
            floor = int(scores[-1]) if len(scores) == k else 1
        return scores, ids


NO_ID = (1 << 63) - 1  # stands for a null id, which comes last


def merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


FOUND = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()),
                      T.StructField("score", T.LongType()), T.StructField("part", T.IntegerType())])


def best_documents(held: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score, part): the ``k`` best documents of each item in each task's share of ``held``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        asked = np.zeros(len(weights), bool)

        def searched(some: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(some).combine_chunks().sort_by("n").combine_chunks()
            ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
            lengths = table.column("n").to_numpy()
            lists, often = (pa.concat_arrays(table.column(c).chunks) for c in ("terms", "tf"))
            at = lists.offsets.to_numpy().astype(np.int64)
            terms, tf, at = lists.flatten().to_numpy(), often.flatten().to_numpy(), at - at[0]
            a = 0
            while a < len(ids):
                z = min(a + BLOCK, len(ids), max(a + 1, int(np.searchsorted(at, at[a] + BLOCK_POSTINGS, side="right")) - 1))
                block = Block(ids[a:z], lengths[a:z], np.diff(at[a : z + 1]), terms[at[a] : at[z]], tf[at[a] : at[z]], weights, n_docs, total)
                for i, item in enumerate(items):
                    asked[item] = True
                    best[i] = block.search(item, asked, best[i], k)
                    asked[item] = False
                a = z

        some, n, size = [], 0, 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            some.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= GATHER * BLOCK or size >= 12 * BLOCK_POSTINGS:
                searched(some)
                some, n, size = [], 0, 0
        if n:
            searched(some)
        rows = [np.repeat(np.arange(len(items)), [len(s) for s, _ in best]).astype(np.int32)] if items else [np.zeros(0, np.int32)]
        ids = np.concatenate([i for _, i in best]) if items else np.zeros(0, np.int64)
        scores = np.concatenate([s for s, _ in best]) if items else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0]), pa.array(ids, mask=ids == NO_ID), pa.array(scores),
             pa.array(np.full(len(ids), TaskContext.get().partitionId(), np.int32))], names=FOUND.names)

    return held.mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Every row of ``docs`` is a document and every row of ``items`` an item, also if ids repeat or are null; equal scores go by
    rising id, null ids last. Null and empty texts have no terms and find nothing. Other columns are not read. Items
    are dealt to blocks by a digest, of about ``block_terms`` terms each; a block's terms and items are what a task holds, and the driver
    fetches them, their document counts and two sums, nothing that grows with the documents. Best rows of tasks are merged
    in two steps, so no task reads those of all.
    """
    named = cut(item_terms(items).withColumn("row", F.monotonically_increasing_id()))
    size = named.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_terms))
    done = None
    for b in range(n_blocks):
        some = sorted(named.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).where("size(terms) > 0").collect(), key=lambda r: r.row)
        number: dict[bytes, int] = {}
        asked = [[number.setdefault(bytes(t), len(number)) for t in r.terms] for r in some]
        held = cut(held_terms(docs, number))
        n_docs, total = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), np.int64)
        for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        found = best_documents(held, asked, weights, n_docs, total, k)
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        near = found.withColumn("near", F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(64))).orderBy(*order))).where(F.col("near") <= k)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(some)], T.StructType([
            T.StructField("item", T.IntegerType()), named.schema["item_id"]]))
        block = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        done = block if done is None else done.unionByName(block)
    return done

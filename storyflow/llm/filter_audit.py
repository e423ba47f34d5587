"""Filter interaction audit by sorted posting lists.

Each filter keeps the sorted list of the documents that fail it, per part of the corpus and per range of ids. What a filter
removes after others is a difference of lists: its own less the union of theirs. Unions are k-way merges and differences two-way
ones; both gallop: they look for the end of a run in doubling steps and take the run as a whole. Ranges do not share
documents, so the sizes of a range's differences are summed over ranges, and every order of the filters is read from these
sums: a step's counts depend on the set of filters before it, not on their order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import cut

BLANKS = r"[\x20\x09-\x0D]+"
RANGE = 1 << 16  # documents in a posting range, at most


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 100,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 80 * F.size(_words(t)),
    "C": lambda t: 100 * F.regexp_count(t, F.lit("[A-Z]")) > 10 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
}
COPIES = "E"  # identical to the text of a smaller id


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang",
             filters: dict[str, Callable[[Column], Column]] = FILTERS, copies: str | None = COPIES) -> DataFrame:
    """(part, none, id, fails): a row a document, bit k of ``fails`` set if it fails the k-th filter, ``copies`` the last one.

    A null text is empty, a null part the empty string. A document fails ``copies`` if a smaller id anywhere has its text; null
    ids come after all others, and rows of one id are no copies of each other. Only digests of texts are shuffled: the
    first id of each repeated text is aggregated, written, and met by a merge join whose hot texts Spark can split.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bits = sum((test(t).cast("int") * (1 << k) for k, test in enumerate(filters.values())), F.lit(0))
    thin = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).isNull().alias("none"),
        F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("id"), F.unhex(F.md5(t)).alias("same"), bits.alias("fails"))
    if copies is None:
        return thin.drop("same")
    thin = cut(thin)
    place = F.struct("none", "id")
    firsts = cut(thin.groupBy("same").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("same", "first"))
    again = F.coalesce(place > F.col("first"), F.lit(False)).cast("int") * (1 << len(filters))
    return thin.hint("merge").join(firsts, "same", "left").select("part", "none", "id", (F.col("fails") + again).alias("fails"))


LISTS = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("failing", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("marked", T.ArrayType(T.ArrayType(T.IntegerType())))])


def posting_lists(rows: DataFrame, n_filters: int, marks: tuple[str, ...] = ()) -> DataFrame:
    """(part, n, failing, marked): for each part and range of ids the sorted lists of its documents.

    ``rows`` has (part, none, id, fails) and the boolean columns ``marks``. ``failing`` has a list a filter, ``marked`` one a mark. A
    document's number is its place in its range, as ids may be null or repeated. Ranges are cut by part, id and a row number,
    so neither a part nor an id with most of the rows is one task; no range has more than ``RANGE`` documents.
    """
    sides = ["fails", *marks]

    def emit(part: str, values: list[np.ndarray]) -> pa.RecordBatch:
        fails, *flags = (np.concatenate(x) for x in zip(*values))
        lists = [[np.flatnonzero(fails >> k & 1) for k in range(n_filters)], [np.flatnonzero(x) for x in flags]]
        kind = pa.list_(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(fails)]), *(pa.array([x], kind) for x in lists)], names=LISTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("part").dictionary_encode()
            code = names.indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in sides]
            for a, z in zip(edges, edges[1:]):
                name = names.dictionary[int(code[a])].as_py()
                while a < z:
                    if held and (name != part or n == RANGE):
                        yield emit(part, held)
                        held, n = [], 0
                    part, stop = name, min(z, a + RANGE - n)
                    held.append([c[a:stop] for c in columns])
                    n, a = n + stop - a, stop
        if held:
            yield emit(part, held)

    order = ["part", "none", "id", "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("part", *sides).mapInArrow(run, LISTS)


def gallop(ids: list[int], at: int, x: int) -> int:
    """The first place from ``at`` on with an id of ``x`` or more, found in doubling steps."""
    if at >= len(ids) or ids[at] >= x:
        return at
    step = 1
    while at + step < len(ids) and ids[at + step] < x:
        at += step
        step *= 2
    return bisect_left(ids, x, at + 1, min(at + step, len(ids)))


def union(lists: list[list[int]]) -> list[int]:
    """Sorted ids that are in any of the sorted ``lists``: a k-way merge that takes runs as a whole."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        x, k, at = heads[0]
        ids, rival = lists[k], min(heads[1:3])[0]
        end = gallop(ids, at, rival)
        out += ids[at:end]
        end += end < len(ids) and ids[end] == rival  # the other list gives it
        if end < len(ids):
            heapreplace(heads, (ids[end], k, end))
        else:
            heappop(heads)
    return out + lists[heads[0][1]][heads[0][2] :] if heads else out


def difference(ids: list[int], gone: list[int]) -> list[int]:
    """Sorted ids that are not in the sorted list ``gone``."""
    out: list[int] = []
    a = g = 0
    while a < len(ids):
        g = gallop(gone, g, ids[a])
        if g == len(gone):
            return out + ids[a:]
        end = gallop(ids, a, gone[g])
        out += ids[a:end]
        a = end + (end < len(ids) and ids[end] == gone[g])
    return out


STEPS = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("before", T.IntegerType()), T.StructField("filter", T.IntegerType()),
    T.StructField("n", T.LongType()), T.StructField("gone", T.LongType()), T.StructField("fails", T.LongType()),
    T.StructField("removed", T.LongType()), T.StructField("marked", T.ArrayType(T.LongType()))])


def audit(lists: DataFrame, n_filters: int, n_marks: int = 0) -> DataFrame:
    """A row for each part, filter and set of filters ``before`` it (a bit mask).

    ``n`` documents, ``gone`` those that fail a filter before, ``fails`` those that fail this one, ``removed`` those it removes
    after them, ``marked`` (an array) how many of these are in each marked list. Counts are sums over the ranges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                failing, found = row["failing"], []
                for before in range(1 << n_filters):
                    others = union([failing[k] for k in range(n_filters) if before >> k & 1])
                    for k in range(n_filters):
                        if not before >> k & 1:
                            lost = difference(failing[k], others)
                            kept = [len(lost) - len(difference(lost, ids)) for ids in row["marked"]]
                            found.append((row["part"], before, k, row["n"], len(others), len(failing[k]), len(lost), kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())))],
                    names=STEPS.names)

    sums = [F.sum(c).alias(c) for c in ("n", "gone", "fails", "removed")] + [F.sum(F.col("marked")[k]).alias(f"m{k}") for k in range(n_marks)]
    done = lists.mapInArrow(run, STEPS).groupBy("part", "before", "filter").agg(*sums)
    marked = F.array(*(F.col(f"m{k}") for k in range(n_marks))) if n_marks else F.array().cast("array<bigint>")
    return done.withColumn("marked", marked).select(*STEPS.names)


def by_order(audited: DataFrame, names: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """The audit read along every order of the filters ``names`` (one letter each): a row a part, order and step.

    ``unique_fails``: documents that fail this filter alone; ``shapley``: removed by it, summed over all orders. The table of
    orders joined here has ``len(names)`` factorial times ``len(names)`` rows, 600 for five filters, whatever the corpus.
    """
    size = len(names)
    every = [("".join(order), step + 1, sum(1 << names.index(x) for x in order[:step]), names.index(order[step]))
             for order in permutations(names) for step in range(size)]
    orders = audited.sparkSession.createDataFrame(every, "filter_order string, step int, before int, filter int")
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size))), F.bit_count("before").cast("int") + 1)
    whole = F.col("before") == (1 << size) - 1 - F.call_function("shiftleft", F.lit(1), F.col("filter"))
    per_filter = audited.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weight).cast("long").alias("shapley"), F.max(F.when(whole, F.col("removed"))).alias("unique_fails"))
    steps = audited.join(per_filter, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])
    return steps.select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        *(F.col("marked")[k].alias(f"{mark}_lost") for k, mark in enumerate(marks)), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters over ``docs``, with the good (quality 1) and toxic (toxic 1) documents lost at each step.

    Every row of ``docs`` counts as a document; ``labels`` count by id, with any of an id's rows, and null ids have none. An empty
    table has no parts and gives no rows. Only the named columns are read, so further ones cannot clash.
    """
    names, marks = "".join(FILTERS) + COPIES, ("good", "toxic")
    said = cut(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        *(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in zip(("quality", "toxic"), marks))).withColumn("none", F.lit(False)))
    rows = failures(docs).hint("merge").join(said, ["id", "none"], "left").fillna(False, list(marks))
    lists = posting_lists(cut(rows.select("part", "none", "id", "fails", *marks)), len(names), marks)
    return by_order(cut(audit(lists, len(names), len(marks))), names, marks)


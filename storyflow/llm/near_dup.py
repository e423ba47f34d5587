"""Near-duplicate documents: MinHash bands propose pairs, odd sketches verify them, full shingle sets confirm them.

1. Each document becomes its set of distinct word shingles; documents with equal sets are one node from then on.
2. A node has ``SAMPLES`` MinHash values. ``BANDS`` (more at a lower limit) groups of ``ROWS`` of them are its buckets; all of them, as pairs (place,
   value), are folded into an odd sketch, a bitmap with the parity of the samples in each bit. The count of bits in
   which two sketches differ gives the similarity, most precisely where it is high.
3. The nodes of a bucket whose sketches are similar enough are tied: a bucket gives a star for those tied to each other, never its pairs.
   Nodes tied to each other, over all buckets, are a cluster.
4. The full sets of a cluster meet once. Likely pairs of different components are confirmed there, likeliest first, and what comes
   out is a star for each component of confirmed links, so the rows that are written grow with the nodes and not with their pairs.
5. Buckets and clusters of more than a block are cut in blocks by hash. First each block is compared with itself, a cluster in
   ``SALTS`` ways of cutting, which joins large groups of copies. What then lies in different components of one bucket or
   cluster is compared block by block, but for blocks of one component with each other. So no link is lost to the cutting.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..operators.components import components
from ..runtime import cut, dealt
from .common import TEXTS, bytes_of, kept, mixed, slices, tidy

SHINGLE = 5  # words
SIMILAR = 85  # percent, unless told otherwise: links have 100 * intersection >= SIMILAR * union
BANDS, ROWS, SAMPLES = 24, 5, 512  # a pair at ``SIMILAR`` shares no bucket with a probability below MISSED
MISSED = 1e-6
BITS = 1024  # of an odd sketch
MARGIN = 0.08  # over four standard deviations of the sketch's estimate at ``SIMILAR``
BLOCK, WEIGHT = 1024, 1 << 20  # nodes compared at once, and shingles of their sets; larger buckets and clusters are cut in blocks
SALTS = 3  # ways to cut a large cluster in blocks
_SLICE = 2 << 20


def bands_for(similar: int) -> int:
    """The number of bands with which a pair of ``similar`` percent shares no bucket with a probability below ``MISSED``."""
    bands = math.ceil(math.log(MISSED) / math.log1p(-((similar / 100) ** ROWS)))
    if bands * ROWS > SAMPLES:
        raise ValueError(f"{similar} percent needs {bands} bands of {ROWS} samples, there are {SAMPLES} samples")
    return bands


def _deviation(similar: int) -> float:
    """Standard deviation of the sketch's estimate of ``similar`` percent: of the agreeing samples, and of flips that meet in a bit."""
    s = similar / 100
    flips = 2 * SAMPLES * (1 - s)
    rest = math.exp(-2 * flips / BITS)
    bits = BITS / 4 * (1 - rest * rest) - flips * rest * rest
    return math.sqrt(s * (1 - s) / SAMPLES + bits / (2 * SAMPLES * rest) ** 2)


def margin_for(similar: int) -> float:
    """``MARGIN``, in the same number of standard deviations at ``similar`` percent."""
    return MARGIN * _deviation(similar) / _deviation(SIMILAR)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    have = kept("powers", "", lambda: [np.zeros(0, np.uint64)] * 2)
    if len(have[0]) < n:
        size = max(n, _SLICE + 1)
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            have[k] = np.cumprod(p)
    return have[0], have[1]


def shingle_sets(raw: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A-Z count as a-z, words are runs of other bytes than the ASCII blanks. A text of fewer words is one shingle.
    """
    n, texts = len(raw), len(at) - 1
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    inside = ~blank[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    rims = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[rims] = inside[rims]
    ends[rims - 1] = inside[rims - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((lower[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    words = mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    cuts = np.searchsorted(first, at)
    count = np.diff(cuts)
    steps = np.array([pow(0xD1B54A32D192ED03, k, 1 << 64) for k in range(shingle)], np.uint64)
    m = max(len(words) - shingle + 1, 0)
    windows = np.zeros(m, np.uint64)
    for k in range(shingle):
        windows += words[k : k + m] * steps[k]
    windows = mixed(windows)
    sets = []
    for d in range(texts):
        a, c = cuts[d], count[d]
        if c >= shingle:
            sets.append(np.unique(windows[a : a + c - shingle + 1]))
        elif c:
            sets.append(mixed(((words[a : a + c] * steps[:c]).sum(keepdims=True) + np.uint64(c)).astype(np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32))


def samples(shingles: np.ndarray) -> np.ndarray:
    """The ``SAMPLES`` MinHash values of a set."""
    a, b = kept("minhash seeds", "", _seeds)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        part = a[:, None] * x[None, k : k + 4096]
        part += b[:, None]
        np.minimum(least, part.min(1), out=least)
    return least


def bands_of(mins: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Bucket numbers of rows of MinHash values, ``bands`` for each."""
    part = mins[:, : bands * ROWS].reshape(len(mins), bands, ROWS).astype(np.uint64)
    code = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(mins), bands))
    for k in range(ROWS):
        code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return code.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Rows of ``BITS`` parities: each (place, value) of the samples flips one bit."""
    place = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bit = (mixed(mins.astype(np.uint64) | place) & np.uint64(BITS - 1)).astype(np.int64)
    flips = np.bincount((bit + np.arange(len(mins))[:, None] * BITS).ravel(), minlength=len(mins) * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(-1, BITS), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    rest = np.maximum(1 - 2 * differing / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(rest)


DOCS = [T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False)),
        T.StructField("sketch", T.BinaryType())]


def _keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that name a set whatever the order of its members; None for the empty one."""
    return [np.array([x.sum(dtype=np.uint64), mixed(x ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)], np.uint64).tobytes()
            if len(x) else None for x in sets]


def described(docs: DataFrame, keep: list[str], text: str, n_bands: int = BANDS) -> DataFrame:
    """``keep`` columns, the key and size of each document's set, its ``n_bands`` buckets and its sketch."""
    rows = dealt(docs.select(*keep, F.col(text).alias("__text")), TEXTS)
    out = T.StructType([*rows.drop("__text").schema.fields, *DOCS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", _SLICE):
            sets = shingle_sets(*bytes_of(batch.column("__text")))
            mins = np.array([samples(s) for s in sets])
            bands = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(mins, n_bands).ravel()), n_bands).cast(pa.list_(pa.int64()))
            sketch = odd_sketches(mins)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in keep), pa.array(_keys(sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                bands, pa.array([x.tobytes() for x in sketch], pa.binary())], names=out.names)

    return rows.mapInArrow(tidy(run), out)


def _join(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of the pairs (a, b), and all that is in one part with them, one number in ``part``."""
    while True:
        x, y = part[a], part[b]
        out = x != y
        if not out.any():
            return
        a, b, x, y = a[out], b[out], x[out], y[out]
        root = np.arange(part.max() + 1)
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        part[:] = root[part]


def _block_pairs(side: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block, some at a time: all of a block with itself, else one side with the other.

    Blocks lie from one of ``ends`` to the next.
    """
    rows = np.arange(ends[0], ends[-1])
    count = np.repeat(ends[1:], np.diff(ends)) - rows - 1
    total = np.cumsum(count)
    done = 0
    while done < len(rows):
        before = total[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(total, before + 400_000)))
        a = np.repeat(rows[done:to], count[done:to])
        b = np.arange(len(a)) - np.repeat(total[done:to] - count[done:to] - before, count[done:to]) + a + 1
        good = (side[a] == 2) | (side[a] != side[b])
        yield a[good], b[good]
        done = to


class _Rows:
    """Rows (group, i, j, side, key, n, sketch, part) of whole blocks as arrays."""

    def __init__(self, rows: pa.Table, similar: int):
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in PLACE:
            x = rows.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        self.ends = np.append(np.flatnonzero(new), rows.num_rows)
        self.keys = rows.column("key").to_pylist()
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(self.keys), -1)
        self.n, self.side = (rows.column(c).to_numpy() for c in ("n", "side"))
        self.names, self.part = np.unique(np.array(rows.column("part").to_pylist(), dtype=object), return_inverse=True)
        self.similar, self.low = similar, similar / 100 - margin_for(similar)

    def likely(self, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of different parts in a block that sizes and sketches allow, some at a time, and their estimates, best first."""
        for a, b in _block_pairs(self.side, ends):
            good = (self.part[a] != self.part[b]) & (
                100 * np.minimum(self.n[a], self.n[b]) >= self.similar * np.maximum(self.n[a], self.n[b]))
            a, b = a[good], b[good]
            value = estimate(np.bitwise_count(self.sketch[a] ^ self.sketch[b]).sum(1, dtype=np.int64))
            order = np.flatnonzero(value >= self.low)
            order = order[np.argsort(-value[order], kind="stable")]
            yield a[order], b[order], value[order]

    def links(self, stars: list[np.ndarray]) -> pa.RecordBatch:
        ends = [x for pairs in stars for x in pairs.T] or [np.zeros(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(self.names[np.concatenate(ends[k::2])], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _stars(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Pairs of each part ``before`` with the least that lies in one part with it ``after``."""
    least = np.full(after.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, after, before)
    each, first = np.unique(before, return_index=True)
    head = least[after[first]]
    return np.stack([head, each], 1)[head != each]


PLACE = ("group", "i", "j")
LINKS = "a binary, b binary"


def _by_blocks(rows: DataFrame, find: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """``find`` applied to whole blocks of (group, i, j, ..) rows, which gives links."""
    dealt = rows.repartition(*PLACE).sortWithinPartitions(*PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            same = np.ones(table.num_rows, bool)
            for c in PLACE:
                x = table.column(c).to_numpy()
                same &= x == x[-1:]
            whole = int(np.argmax(same))  # the last block may go on in the next batch
            if whole:
                yield find(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield find(pa.Table.from_batches(held))

    return dealt.mapInArrow(tidy(run), LINKS)


def ties(members: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(a, b) from (group, i, j, side, key, n, sketch, part) rows: parts that likely pairs in a block tie to the part a."""

    def find(table: pa.Table) -> pa.RecordBatch:
        rows = _Rows(table, similar)
        before = rows.part.copy()
        for a, b, _ in rows.likely(rows.ends):
            _join(rows.part, a, b)
        return rows.links([_stars(before, rows.part)])

    return _by_blocks(members, find)


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members two different sets ``a[k]`` and ``b[k]`` have in common: bitmaps over the members that two sets hold, a strip at a time."""
    used, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    member = np.concatenate([sets[r] for r in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[r]) for r in used])
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    new = np.append(True, member[1:] != member[:-1]) if len(member) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    several = (np.bincount(column) > 1)[column]
    owner, column = owner[several], np.cumsum(new[several]) - 1
    strip, out = 1 << 13, np.zeros(len(a), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, strip):
        lo, hi = np.searchsorted(column, [start, start + strip])
        width = min(strip, -(-(int(column[hi - 1]) + 1 - start) // 64) * 64)
        grid = np.zeros((len(used), width), bool)
        grid[owner[lo:hi], column[lo:hi] - start] = True
        bits = np.packbits(grid, axis=1).view(np.uint64)
        for k in range(0, len(a), 1 << 14):
            out[k : k + (1 << 14)] += np.bitwise_count(bits[a[k : k + (1 << 14)]] & bits[b[k : k + (1 << 14)]]).sum(1, dtype=np.int64)
    return out


def confirmed(members: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(a, b) from rows as in ``ties`` with their ``set``: parts that links in a block, confirmed on full sets, join to the part a."""

    def find(table: pa.Table) -> pa.RecordBatch:
        rows, found = _Rows(table, similar), []
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("set").chunks for x in c]
        for begin, end in zip(rows.ends[:-1].tolist(), rows.ends[1:].tolist()):
            a, b, value = (np.concatenate(x) for x in zip(*rows.likely(np.array([begin, end]))))
            order = np.argsort(-value, kind="stable")
            a, b, step = a[order], b[order], 4 * (end - begin)
            part = rows.part[begin:end].copy()
            while len(a):
                x, y = a[:step], b[:step]
                both = shared(sets, x, y)
                good = 100 * both >= similar * (rows.n[x] + rows.n[y] - both)
                _join(part, x[good] - begin, y[good] - begin)
                a, b = a[step:], b[step:]
                left = part[a - begin] != part[b - begin]
                a, b, step = a[left], b[left], 4 * step
            found.append(_stars(rows.part[begin:end], part))
        return rows.links(found)

    return _by_blocks(members, find)


def _blocks(nodes, shingles=None):
    """How many blocks so many nodes, with so many shingles in all, are cut in."""
    by_count = F.ceil(nodes / BLOCK)
    return by_count if shingles is None else F.greatest(by_count, F.ceil(shingles / WEIGHT))


def _against_all(rows: DataFrame, weighed: bool) -> DataFrame:
    """(group, key, part, n) rows with (i, j, side), once for each block they are compared with.

    A part that fills several blocks has blocks of its own, which are not compared with each other; smaller parts share blocks.
    """
    size = lambda m, w: _blocks(F.col(m), F.col(w) if weighed else None)
    parts = cut(rows.groupBy("group", "part").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("own", size("m", "w")))
    own, rest = F.when(F.col("own") > 1, F.col("own")), F.col("own") == 1
    all_ = parts.groupBy("group").agg(
        F.coalesce(F.sum(own), F.lit(0)).alias("owned"), F.sum(F.when(rest, F.col("m"))).alias("m"), F.sum(F.when(rest, F.col("w"))).alias("w"),
        F.count("*").alias("parts")).where("parts > 1").withColumn("mixed", F.coalesce(size("m", "w"), F.lit(0)))
    all_ = cut(all_.select("group", "mixed", (F.col("mixed") + F.col("owned")).alias("blocks")))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = cut(parts.where("own > 1").select("group", "part", "own", before.alias("before")))
    at = rows.join(all_, "group").join(large, ["group", "part"], "left")
    low, hashed = F.col("mixed") + F.col("before"), F.xxhash64("key")
    at = at.withColumn("low", low).withColumn("mine", F.when(F.col("own").isNull(), F.pmod(hashed, "mixed")).otherwise(F.col("low") + F.pmod(hashed, "own")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                      lambda k: F.col("own").isNull() | (k < F.col("low")) | (k >= F.col("low") + F.col("own")))
    at = at.withColumn("k", F.explode(others))
    return at.select("group", "key", "part", "n", F.least("k", "mine").alias("i"), F.greatest("k", "mine").alias("j"),
                     F.when(F.col("k") == F.col("mine"), 2).when(F.col("mine") < F.col("k"), 0).otherwise(1).alias("side"))


def _with_itself(rows: DataFrame, salts: int) -> DataFrame:
    """(group, key, part, n, blocks) rows with (i, j, side): each block with itself, cut in ``salts`` ways if there are several."""
    ways = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(salts))))
    at = rows.withColumn("salt", F.explode(ways)).withColumn(
        "i", F.col("salt") * F.col("blocks") + F.pmod(F.xxhash64("key", "group", "salt"), "blocks"))
    return at.select("group", "key", "part", "n", "i", F.col("i").alias("j"), F.lit(2).alias("side"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: int = SIMILAR) -> DataFrame:
    """(doc_id, tie, n_shingles, component, component_id, kept): the component of links each document belongs to.

    A link needs ``similar`` percent of two documents' distinct shingles in common; ``component_id`` is the least id of the
    component. Null texts and texts without words have no shingles and are linked with nothing, so they are components
    of their own. A null id is no component's name: such a document has a null component if all ids there are, and is not kept.
    Repeated rows are in one component. ``tie`` is a digest of the text, ``component`` a name that is null only without
    shingles. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    table = cut(described(rows, ["doc_id", "tie"], "text", bands_for(similar)))
    nodes = cut(table.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tie")).alias("source"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    in_bucket = nodes.select("key", F.explode("bands").alias("group"))
    short = F.xxhash64("key")
    crowded = in_bucket.groupBy("group").agg(F.min(short).alias("x"), F.max(short).alias("y"), F.count("*").alias("m")).where("x <> y")
    members = cut(in_bucket.join(cut(crowded.select("group", _blocks(F.col("m")).alias("blocks"))), "group"))
    about = nodes.select("key", "n", "sketch")
    alone = nodes.select("key", "n").withColumn("part", F.col("key"))

    tied = cut(ties(_with_itself(members.join(alone, "key"), 1).join(about.drop("n"), "key"), similar).distinct())
    cluster = cut(_named(tied, "group"))
    sized = cut(cluster.join(nodes.select("key", "n"), "key").groupBy("group").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")))
    placed = _with_itself(cluster.join(sized, "group").join(alone, "key"), SALTS)
    links = cut(confirmed(_with_sets(placed, rows, nodes), similar))
    part = cut(_named(links, "part"))

    wide, large = members.where("blocks > 1"), sized.where("blocks > 1")
    if not (wide.isEmpty() and large.isEmpty()):
        now = cut(nodes.select("key", "n").join(part, "key", "left").withColumn("part", F.coalesce("part", "key")))
        more = ties(_against_all(wide.select("group", "key").join(now, "key"), False).join(about.drop("n"), "key"), similar)
        again = cluster.join(large, "group", "left_semi").join(now, "key").select(F.col("group").alias("a"), F.col("part").alias("b"))
        open_ = cut(more.unionByName(again).where("a <> b").distinct())  # the least key of a cluster names its part, too
        if not open_.isEmpty():
            cluster = cut(_named(open_, "group")).withColumnRenamed("key", "part")
            placed = _against_all(now.join(cluster, "part"), True)
            links = cut(confirmed(_with_sets(placed, rows, nodes), similar))
            if not links.isEmpty():
                renamed = cut(_named(links, "to")).withColumnRenamed("key", "part")
                part = cut(now.join(renamed, "part", "left").select("key", F.coalesce("to", "part").alias("part")))
    joined = cut(nodes.select("key", "least").join(part, "key", "left").select("key", "least", F.coalesce("part", "key").alias("component")))
    least = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    names = joined.join(least, "component").select("key", "component", "component_id")
    done = table.select("doc_id", "tie", "key", F.col("n").alias("n_shingles")).join(cut(names), "key", "left")
    named = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return done.select("doc_id", "tie", "n_shingles", "component", named.alias("component_id"), F.coalesce(named == F.col("doc_id"), F.lit(False)).alias("kept"))


def _named(links: DataFrame, name: str) -> DataFrame:
    """(key, ``name``) of the keys in (a, b) links: their connected component."""
    return components(links.select(F.col("a").alias("i"), F.col("b").alias("j"))).select(F.col("node").alias("key"), F.col("component").alias(name))


def _with_sets(placed: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``placed`` rows with the sketch and set of their key; the sets are made anew from the text of one of its documents."""
    placed = cut(placed)
    sources = nodes.join(placed.select("key").distinct(), "key", "left_semi").select(
        F.coalesce("source.doc_id", F.lit(-1)).alias("id"), F.col("source.doc_id").isNull().alias("none"), F.col("source.tie").alias("tie"))
    named = rows.withColumn("id", F.coalesce("doc_id", F.lit(-1))).withColumn("none", F.col("doc_id").isNull())
    some = named.join(cut(sources), ["id", "none", "tie"], "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            sets = shingle_sets(*bytes_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([
                pa.array(_keys(sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "set"])

    sets = some.mapInArrow(tidy(run), "key binary, set binary").dropDuplicates(["key"])
    return placed.join(sets, "key").join(nodes.select("key", "sketch"), "key")

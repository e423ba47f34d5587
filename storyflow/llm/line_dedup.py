"""Line de-duplication by winnowing over line hashes.

A run is a stretch of consecutive lines of a document that has ``lines`` lines, or fewer with ``words`` words in all.
A line goes if it lies in a run that occurs earlier: in a document of smaller id, or further up in its own. The first
occurrence of each run stays.

Every run elects the line with the least hash as its fingerprint, so two equal runs share one for certain. Fingerprints
found at one place only are put aside, which leaves little of a corpus. Where a fingerprint occurs again, the runs that
elected it are its match extended to both sides; equal ones meet by their hash, the earliest place is found by an
aggregate, and the later places are joined to it. No pair of occurrences is ever made, so a line or passage that most
documents share costs one row an occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut

LINES = 3
WORDS = 50


WORD = r"[^\x20\x09-\x0D]+"


def _filled(line: Column) -> Column:
    """Whether a line holds more than blanks."""
    return line.rlike(WORD)


def runs(docs: DataFrame, lines: int, words: int) -> DataFrame:
    """(no_id, id, tie, k, n, run, print, new): the qualified runs of 1 to ``lines`` lines of every document.

    A run is the ``n`` filled lines from the k-th on; ``run`` is a digest of them, ``print`` the least line hash, the run's
    fingerprint. ``new`` is false where the run before it has elected the same line.
    """
    each = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: F.struct(
        F.xxhash64(x).alias("hash"), F.md5(x).alias("same"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    seq = docs.select("no_id", "id", "tie", F.filter(each, lambda x: x["words"] > 0).alias("seq"))
    starts = seq.select("no_id", "id", "tie", F.posexplode(F.expr(
        f"transform(sequence(1, greatest(size(seq), 1)), k -> struct(slice(seq, k, {lines}) AS w, "
        f"IF(k > 1, slice(seq, k - 1, {lines}), slice(seq, 1, 0)) AS before))")).alias("k", "at")).where("size(at.w) > 0")
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.size("at.w")), lambda n: F.slice("at.w", 1, n)), lambda w: (
        F.size(w) == lines) | (F.aggregate(w, F.lit(0), lambda s, x: s + x["words"]) >= words))
    each = starts.select("no_id", "id", "tie", "k", "at.before", F.explode(cuts).alias("w"))

    def elected(w: Column) -> Column:  # the leftmost, if several lines are equal
        hashes = F.transform(w, lambda x: x["hash"])
        return F.array_position(hashes, F.array_min(hashes))

    same = (F.size("w") == lines) & (F.size("before") == lines) & (elected(F.col("before")) == elected(F.col("w")) + 1)
    return each.select(
        "no_id", "id", "tie", "k", F.size("w").alias("n"),
        F.unhex(F.md5(F.array_join(F.transform("w", lambda x: x["same"]), ""))).alias("run"),
        F.array_min(F.transform("w", lambda x: x["hash"])).alias("print"), (~F.coalesce(same, F.lit(False))).alias("new"))


def repeated_lines(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """(no_id, id, tie, gone): which filled lines to delete, counted from 0, of documents that have any.

    The tables joined here grow with the corpus, so they meet by merge joins at every size.
    """
    found = cut(runs(docs, lines, words))
    prints = found.where("new").groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    again = found.hint("merge").join(cut(prints), "print", "left_semi")
    where = F.struct("no_id", "id", "tie", "k")
    firsts = again.groupBy("run").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").select("run", "first")
    later = again.hint("merge").join(cut(firsts), "run").where(where > F.col("first"))
    return later.select("no_id", "id", "tie", F.explode(F.sequence("k", F.col("k") + F.col("n") - 1)).alias("line")).distinct().groupBy(
        "no_id", "id", "tie").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def _without(parts: Column, gone: Column) -> Column:
    """``parts`` less the filled ones numbered in ``gone`` (sorted), by slices between stretches of deleted ones."""
    at = F.filter(F.transform(parts, lambda x, i: F.when(_filled(x), i)), lambda i: i.isNotNull())
    held = F.struct(parts.alias("parts"), F.transform(gone, lambda k: F.get(at, k)).alias("at"))

    def use(h: Column) -> Column:
        first = F.filter(h["at"], lambda x, i: (i == 0) | (F.get(h["at"], i - 1) != x - 1))
        last = F.filter(h["at"], lambda x, i: (i == F.size(h["at"]) - 1) | (F.get(h["at"], i + 1) != x + 1))
        begins = F.concat(F.array(F.lit(0)), F.transform(last, lambda x: x + 1))
        ends = F.concat(first, F.array(F.size(h["parts"])))
        return F.flatten(F.zip_with(begins, ends, lambda a, z: F.slice(h["parts"], a + 1, z - a)))

    return F.element_at(F.transform(F.array(held), use), 1)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lines: int = LINES, words: int = WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and ``n_lines`` and ``n_deleted`` (both long) added.

    Lines are parted by line feeds and compared as they are; lines of blanks alone belong to no run and stay. A null
    text stays null and an empty one empty, with no lines. Rows with null ids come last. Rows alike in id and text
    are one document: they do not repeat each other and get the same result. All rows and other columns stay; in
    their place come columns ``n_lines`` and ``n_deleted`` if there are such. ``collect_set`` holds lines of one text.
    """
    rows = docs.withColumns({"__no": F.col(doc_id).isNull(), "__id": F.coalesce(F.col(doc_id), F.lit(0)), "__tie": F.xxhash64(text)})
    keys = rows.select(F.col("__no").alias("no_id"), F.col("__id").alias("id"), F.col("__tie").alias("tie"), F.col(text).alias("text"))
    gone = repeated_lines(keys, lines, words).select(
        F.col("no_id").alias("__no"), F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("gone").alias("__gone"))
    rest = F.array_join(_without(F.split(F.col(text), "\n", -1), F.col("__gone")), "\n")
    n_lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.regexp_count(F.col(text), F.lit("\n")) + 1)
    return rows.hint("merge").join(gone, ["__no", "__id", "__tie"], "left").withColumns({
        "n_lines": n_lines.cast("long"),
        "n_deleted": F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long"),
        text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest)}).drop("__no", "__id", "__tie", "__gone")

"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule takes the point frac((i + 1/2) / golden ratio); the points fill [0, 1) evenly at every length,
so mapped through the cumulative target shares any stretch of the schedule holds every source in proportion. The r-th
slot of a source takes the r-th block of the source's shuffled words: documents in the order of a digest, laid end
to end, round again when they are used up, and cut in blocks of equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut

WEIGHTS = (5, 2, 1)  # of the sources in code point order, null last, repeating
TIMES = 3  # a source's target, and so a document, is taken so often at most
BLOCK = 4096  # words of a slot
GOLDEN = 0.6180339887498949


def word_count(text: str | Column) -> Column:
    """Words are runs of other characters than the ASCII blanks; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[str], value: Column) -> DataFrame:
    """``df`` with ``nth`` (rank from 0) and ``before`` (sum of ``value`` over all earlier rows) in total ``order``.

    Rows are dealt by ranges and written, so that what follows sees one numbering; ranks and sums are taken inside
    each range, and only one row per range is summed across them.
    """
    ranged = cut(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    across = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "__part", F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(across), F.lit(0)).alias("__s"))
    inside = ranged.withColumn("__i", F.count("*").over(here) - 1).withColumn("__b", F.sum("__v").over(here) - F.col("__v"))
    return inside.join(bases, "__part").withColumn("nth", F.col("__i") + F.col("__n")).withColumn(
        "before", F.col("__b") + F.col("__s")).drop("__part", "__v", "__i", "__b", "__n", "__s")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """(no_source, source, source_no, source_size, first_word, target, words) from (no_source, source, size) rows.

    ``target`` shares out the sum of all sizes by weight, at most ``times`` the source's size, the excess reshared
    until none is above; ``words`` is the target in whole words. Each round of resharing fetches two sums.
    """
    totals = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    known = cut(running(totals, ["no_source", "source"], F.col("source_size")).withColumn("weight", weight.cast("long")))
    limit = F.col("source_size") * times
    total = known.agg(F.sum("source_size")).first()[0] or 0
    fixed, rate, before = 0, 0.0, -1
    while True:
        full = F.lit(rate) * F.col("weight") >= limit if before >= 0 else F.lit(False)
        n, fixed, free = known.agg(
            F.sum(full.cast("long")), F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if n is None or not free or n == before:
            break
        rate, before = (total - fixed) / free, n
    free_target = (F.lit(float(total - (fixed or 0))) / F.lit(float(free or 1))) * F.col("weight")
    target = F.when(full, limit.cast("double")).otherwise(free_target) if free else limit.cast("double")
    return known.select(
        "no_source", "source", F.col("nth").alias("source_no"), "source_size", F.col("before").alias("first_word"),
        target.alias("target"), F.least(F.round(target).cast("long"), limit).alias("words"))


def schedule(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_no, nth_of_source, slots) from (source_no, words) rows: which source each slot takes.

    A source that no point has hit, though it has words to give, gets one slot at the end. Points and shares meet in
    cells of [0, 1) by an equi-join; there are at least as many cells as sources.
    """
    spark = shares.sparkSession
    shares = cut(running(shares.where("words > 0").select("source_no", "words"), ["source_no"], F.col("words")).select("source_no", "words", "before"))
    n_sources, total = shares.agg(F.count("*"), F.sum("words")).first()
    total = total or 0
    n = -(-total // block)
    cells = 1 << max(6, (max(n // 1024, n_sources) - 1).bit_length())
    x = F.lit(float(max(total, 1)))
    ends = shares.select("source_no", (F.col("before") / x).alias("lo"), ((F.col("before") + F.col("words")) / x).alias("hi"))
    ends = ends.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    point = (F.col("slot") + 0.5) * GOLDEN
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * cells))
    hit = points.join(ends, "cell").where("u >= lo AND u < hi").select("slot", "source_no")
    hit = cut(hit)
    rest = shares.join(hit.select("source_no").distinct(), "source_no", "left_anti").select((F.col("source_no") + n).alias("slot"), "source_no")
    slots = running(hit.unionByName(rest), ["source_no", "slot"], F.lit(1))
    counts = slots.groupBy("source_no").agg(F.min("nth").alias("first"), F.count("*").alias("slots"))
    return slots.join(counts, "source_no").select("slot", "source_no", (F.col("nth") - F.col("first")).alias("nth_of_source"), "slots")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        times: int = TIMES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of the mix.

    rows: ``row`` (a number), doc_id, tie (a digest of the text), no_source, source, size, source_size, target, ``copies`` (how often the document is begun).
    pieces: slot, row, from_word, n_words, a document's part in a block; their sum per row is what the mix takes.

    Null texts have no words and are in no piece; a null source is a source of its own; repeated rows are separate documents;
    an empty table gives empty results. Every source gives its target in whole words exactly, its documents the
    same number of times give or take one, ``times`` at most. The order is a digest of the id, so reruns agree.
    """
    rows = cut(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("key")))
    goals = cut(targets(rows, weights, times))
    placed = running(rows, ["no_source", "source", "key", "doc_id", "size"], F.col("size"))
    placed = placed.join(goals, ["no_source", "source"]).withColumn("at", F.col("before") - F.col("first_word"))
    begun = F.expr("(words - at + source_size - 1) div greatest(source_size, 1)")
    placed = cut(placed.select(
        F.col("nth").alias("row"), "doc_id", "tie", "no_source", "source", "source_no", "size", "source_size", "target", "words", "at",
        F.when(F.col("size") > 0, begun).otherwise(0).cast("long").alias("copies")))
    slots = cut(schedule(goals, block))
    counts = slots.groupBy("source_no").agg(F.count("*").alias("slots"))
    spans = placed.where("copies > 0").join(counts, "source_no").select(
        "row", "source_no", "words", "size", F.explode(F.expr("transform(sequence(0L, copies - 1), k -> k * source_size + at)")).alias("a"),
        F.expr("words div slots").alias("each"), F.expr("words % slots").alias("more"))
    spans = spans.withColumn("z", F.least(F.col("a") + F.col("size"), F.col("words")))

    def block_of(x: str) -> Column:  # the first blocks are one word longer, so that all together give the target
        return F.expr(f"CASE WHEN {x} < more * (each + 1) THEN ({x}) div (each + 1) ELSE more + ({x} - more * (each + 1)) div greatest(each, 1) END")

    parts = spans.withColumn("nth_of_source", F.explode(F.sequence(block_of("a"), block_of("z - 1"))))
    begin = F.col("nth_of_source") * F.col("each") + F.least("nth_of_source", "more")
    end = begin + F.col("each") + (F.col("nth_of_source") < F.col("more")).cast("long")
    pieces = parts.join(slots.select("slot", "source_no", "nth_of_source"), ["source_no", "nth_of_source"]).select(
        "slot", "row", (F.greatest(begin, "a") - F.col("a")).alias("from_word"), (F.least(end, "z") - F.greatest(begin, "a")).alias("n_words"))
    return placed.select("row", "doc_id", "tie", "no_source", "source", "size", "source_size", "target", "copies"), pieces


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: the words the pieces hold of it."""
    sums = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return rows.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The documents of ``docs`` as whole rows, each as often as the mix begins it (0 to ``times`` times).

    Rows alike in id, text and source share what the mix takes of them as evenly as whole rows allow.
    """
    rows, _ = mix(docs, text, doc_id, source, **how)
    keys = ["__none", "__id", "__tie", "__no", "__source"]
    named = lambda df: df.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__no": F.col("no_source")})
    wanted = named(rows).withColumns({"__tie": F.col("tie"), "__source": F.col("source")}).groupBy(*keys).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    own = docs.withColumns({
        "__none": F.col(doc_id).isNull(), "__id": F.coalesce(F.col(doc_id), F.lit(0)), "__tie": F.xxhash64(text),
        "__no": F.col(source).isNull(), "__source": F.coalesce(F.col(source), F.lit(""))})
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    share = own.join(cut(wanted), keys).withColumn("__nth", nth).withColumn(
        "__times", F.expr("__copies div __rows + IF(__nth <= __copies % __rows, 1, 0)"))
    return share.withColumn("__copy", F.explode(F.expr("sequence(1L, greatest(__times, 1L))"))).where("__times > 0").select(docs.columns)

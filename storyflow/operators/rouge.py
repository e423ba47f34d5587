"""ROUGE-2 of a digest against all texts of its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# Fixed value: what parts two documents in the reference text.
MARK = "[DOC_SEP]"


def rouge_words(text: Column) -> Column:
    """Words as scored: sentences part at ``.``, blanks are folded; a blank sentence is one empty word."""
    parts = F.filter(F.split(text, r"\."), lambda p: F.length(p) > 0)
    return F.flatten(F.transform(parts, lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " ")))


def bigrams(words: Column) -> Column:
    pairs = T.once(words, lambda ws: F.transform(
        F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, n: F.concat(ws[n], F.lit(" "), w)))
    return F.array_distinct(pairs)


def text_bigrams(texts: DataFrame) -> DataFrame:
    """(group, bigram), distinct, of the group's texts joined by the mark — without joining them.

    Every text but the first gets the mark in front and every text but the last behind, so
    the bigrams over each border appear in one of its two texts.
    """
    ends = texts.groupBy("group").agg(F.min("article").alias("first"), F.max("article").alias("last"))
    rows = texts.join(ends, "group")
    marked = F.concat(
        F.when(F.col("article") > F.col("first"), MARK + " ").otherwise(""), "text",
        F.when(F.col("article") < F.col("last"), " " + MARK).otherwise(""))
    return rows.select("group", marked.alias("text")).select(
        "group", F.explode(bigrams(rouge_words(F.col("text")))).alias("bigram")).distinct()


def rouge2(summaries: DataFrame, texts: DataFrame) -> DataFrame:
    """(group, rouge2_precision, rouge2_recall, rouge2_f1) over distinct bigrams."""
    ours = summaries.select("group", F.explode(bigrams(rouge_words(F.col("summary")))).alias("bigram"))
    wanted = summaries.select("group").distinct()
    theirs = text_bigrams(texts.join(wanted, "group", "left_semi"))
    n_theirs = theirs.groupBy("group").agg(F.count("*").alias("r"))
    n_ours = ours.groupBy("group").agg(F.count("*").alias("c"))
    n_both = ours.join(theirs, ["group", "bigram"], "left_semi").groupBy("group").agg(F.count("*").alias("o"))
    out = wanted.join(n_ours, "group", "left").join(n_theirs, "group", "left").join(n_both, "group", "left").na.fill(0)
    p = F.when(F.col("c") == 0, 0.0).otherwise(F.col("o") / F.nullif("c", F.lit(0)))
    r = F.when(F.col("r") == 0, 0.0).otherwise(F.col("o") / F.nullif("r", F.lit(0)))
    # Fixed value: 1e-8 keeps the quotient defined
    f1 = 2.0 * (F.col("p") * F.col("q") / (F.col("p") + F.col("q") + 1e-8))
    return out.select("group", p.alias("p"), r.alias("q")).select(
        "group", F.col("p").alias("rouge2_precision"), F.col("q").alias("rouge2_recall"), f1.alias("rouge2_f1"))


def compare_methods(first: DataFrame, second: DataFrame, texts: DataFrame, limit: int = 5) -> DataFrame:
    """Both summaries of the first ``limit`` groups side by side with their scores."""
    both = first.withColumnRenamed("summary", "summary_1").join(second.withColumnRenamed("summary", "summary_2"), "group")
    both = both.orderBy("group").limit(limit)
    names = ("rouge2_precision", "rouge2_recall", "rouge2_f1")
    for n in ("1", "2"):
        scores = rouge2(both.select("group", F.col(f"summary_{n}").alias("summary")), texts)
        both = both.join(scores.withColumnsRenamed({c: f"{c}_{n}" for c in names}), "group")
    return both

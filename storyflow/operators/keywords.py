"""Weighted keywords per text from several signals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EXCLUDED_ENTITY_LABELS, LEXICON, SIGNAL_WEIGHTS, STOP_WORDS
from ..functions import text as T

SIGNAL_ORDER = ("pos", "ner", "model", "manual")


def _any_of(entries: Sequence[str]) -> str:
    """A pattern for the longest of the ``entries`` that stands at a place; common beginnings are tried once."""
    tree: dict = {}
    for entry in entries:
        node = tree
        for c in entry:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(c) + pattern(after) for c, after in node.items() if c]
        if not ways:
            return "" if node else "(?!)"
        return ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)}){'?' if '' in node else ''}"

    return pattern(tree)


def lexicon_hits(text: Column, lexicon: Sequence[str] = LEXICON, mode: str = "suffix") -> Column:
    """Lexicon entries found in ``text``, in lexicon order.

    ``suffix``: the entry is a word, or stands before a blank (so ``ai`` also matches in
    ``thai food``). ``word``: whole words only. The entries are literals of the plan; ``lexicon_join``
    finds the same with a table.

    The text is read once, whatever the number of entries: a pattern of their common beginnings is tried where an entry may
    stand and finds the longest one there; those that stand at the same place are its own ends, or beginnings.
    """
    lexicon = list(dict.fromkeys(lexicon))
    entries = F.array(*(F.lit(k) for k in lexicon)).cast("array<string>")
    key = T.headline_key(text)
    if mode == "word":
        padded = F.concat(F.lit(" "), F.array_join(T.words(key), " "), F.lit(" "))
        found = F.array_distinct(F.regexp_extract_all(padded, F.lit(f" (?=({_any_of(lexicon)} ))"), F.lit(1)))
        return T.once(found, lambda s: F.filter(entries, lambda k: F.exists(s, lambda f: F.startswith(f, F.concat(k, F.lit(" "))))))
    # read from the end: an entry follows a blank there; whole words also stand before other white space and at the end
    ends = _any_of([k[::-1] for k in lexicon])
    whole = _any_of([k[::-1] for k in lexicon if not any(c in k for c in " \t\n\x0b\f\r")])

    def found(back: Column) -> Column:
        before = F.array_distinct(F.regexp_extract_all(back, F.lit(f" (?=({ends}))"), F.lit(1)))
        lines = F.concat(F.lit("\n"), back, F.lit("\n"))
        alone = F.regexp_extract_all(lines, F.lit(rf"[\t\n\x0B\f\r](?=({whole})\s)"), F.lit(1))
        return F.struct(F.transform(before, F.reverse).alias("before"), F.transform(alone, F.reverse).alias("alone"))

    return T.once(T.once(F.reverse(key), found), lambda s: F.filter(
        entries, lambda k: F.exists(s.before, lambda f: F.endswith(f, k)) | F.array_contains(s.alone, k)))


def lexicon_match(texts: DataFrame, lexicon: Sequence[str] = LEXICON, mode: str = "suffix",
                  id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, keyword, ordinal)."""
    return texts.select(id_col, F.posexplode(lexicon_hits(F.col(text_col), lexicon, mode)).alias("ordinal", "keyword")).select(
        id_col, "keyword", "ordinal")


def lexicon_join(texts: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text", mode: str = "word") -> DataFrame:
    """(id, keyword): ``lexicon_hits`` against a lexicon table of any size, as an equi-join.

    Texts give their runs of words up to the longest entry; for ``suffix`` also, before a blank, those that begin
    inside a word.
    """
    entries = lexicon.select("keyword").where(F.col("keyword") != "").distinct()
    longest = entries.agg(F.max(F.size(F.split("keyword", " ")))).first()[0] or 0
    key = T.headline_key(F.col(text_col))
    span = F.sequence(F.lit(1), F.lit(max(1, longest)))

    def runs(words: Column, until: Column) -> Column:
        """All runs of 1 to ``longest`` of the words, the last one at ``until`` at most."""
        return F.flatten(F.transform(words, lambda w, i: F.transform(
            F.filter(span, lambda n: i + n <= until), lambda n: F.array_join(F.slice(words, i + 1, n), " "))))

    words = T.words(key)
    if mode == "word":
        found = T.once(words, lambda w: runs(w, F.size(w)))
    else:
        before = F.split(key, " ")  # all but the last of these stand before a blank
        inner = T.once(before, lambda w: F.flatten(F.transform(runs(w, F.size(w) - 1), lambda r: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(F.substring_index(r, " ", 1)), F.lit(1))), lambda p: F.substring(r, p, F.length(r))))))
        found = F.concat(inner, words)
    rows = texts.select(id_col, F.explode(F.array_distinct(found)).alias("keyword"))
    return rows.join(entries, "keyword", "left_semi").select(id_col, "keyword")


def keep_pos(tokens: DataFrame, keep: Sequence[str] = ("NOUN", "PROPN")) -> DataFrame:
    """Lemmas of the wanted parts of speech, stop words out. Verbs are not kept by default."""
    return tokens.where(F.col("pos").isin(*keep) & ~F.col("is_stop"))


def keep_entities(entities: DataFrame, excluded: Sequence[str] = EXCLUDED_ENTITY_LABELS) -> DataFrame:
    return entities.where(~F.col("label").isin(*excluded)).withColumn("keyword", F.lower("text"))


def fuse_keywords(signals: DataFrame, weights: dict[str, float] = SIGNAL_WEIGHTS, min_score: float = 1.0) -> DataFrame:
    """(id, keyword, signal, confidence, ordinal) → (id, keyword, score, rank).

    Scores add up over signals and occurrences; model keywords weigh their rescaled
    confidence. Kept when above ``min_score``; ranked by score, then first appearance.
    """
    weight = F.when(F.col("signal") == "model", T.model_score(F.col("confidence")))
    for name, value in weights.items():
        weight = weight.when(F.col("signal") == name, F.lit(value))
    place = F.array_position(F.array(*(F.lit(s) for s in SIGNAL_ORDER)), F.col("signal"))
    scored = (
        signals.select("id", F.lower("keyword").alias("keyword"), weight.alias("w"), F.struct(place.alias("s"), "ordinal").alias("at"))
        .groupBy("id", "keyword").agg(F.round(F.sum("w"), 6).alias("score"), F.min("at").alias("at"))
        .where(F.col("score") > min_score))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "at", "keyword")
    return scored.withColumn("rank", F.row_number().over(order)).select("id", "keyword", "score", "rank")


def keyword_lists(ranked: DataFrame) -> DataFrame:
    """(id, keywords): the ranked list of each text."""
    return ranked.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x.keyword).alias("keywords"))


# ---------------------------------------------------------------- built-in signals

# The last + is possessive: nothing follows, so nothing is to be given back, and Java walks a run of any length without recursion.
SPAN = r"[A-Z][a-z]+(?: [A-Z][a-z]+)++"


def word_signal(texts: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Stands in for a tagger: every token that is no stop word counts as a noun."""
    rows = texts.select("id", F.posexplode(T.tokens(F.col("text"), stop_words)).alias("ordinal", "keyword"))
    return rows.select(
        "id", "keyword", F.lit("pos").alias("signal"), F.lit(None).cast("double").alias("confidence"), "ordinal")


def span_signal(texts: DataFrame) -> DataFrame:
    """Stands in for an entity model: runs of two or more capitalised words."""
    spans = F.regexp_extract_all("text", F.lit(SPAN), F.lit(0))
    return texts.select("id", F.posexplode(spans).alias("ordinal", "keyword")).select(
        "id", "keyword", F.lit("ner").alias("signal"), F.lit(None).cast("double").alias("confidence"), "ordinal")


def vector_signal(vectors: DataFrame, top: int = 5) -> DataFrame:
    """Stands in for an embedding model: the strongest TF-IDF terms, weight as confidence."""
    ranked = F.array_sort(F.transform("vec", lambda x: F.struct((-F.round(x.w, 6)).alias("neg"), x.term.alias("term"))))
    return vectors.select("id", F.posexplode(F.slice(ranked, 1, top)).alias("ordinal", "x")).select(
        "id", F.col("x.term").alias("keyword"), F.lit("model").alias("signal"),
        (-F.col("x.neg")).alias("confidence"), "ordinal")


def lexicon_signal(texts: DataFrame, lexicon: Sequence[str] = LEXICON) -> DataFrame:
    return lexicon_match(texts, lexicon).select(
        "id", "keyword", F.lit("manual").alias("signal"), F.lit(None).cast("double").alias("confidence"), "ordinal")


# ---------------------------------------------------------------- model hooks

Annotator = Callable[[pd.Series], pd.Series]


def annotate(texts: DataFrame, load: Callable[[], Annotator], schema: str, text_col: str = "text",
             out: str = "annotation") -> DataFrame:
    """Adds what a language model says of each text. ``load`` runs once per worker task."""

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return texts.withColumn(out, run(F.col(text_col)))


def embed(texts: DataFrame, load: Callable[[], Annotator], text_col: str = "text") -> DataFrame:
    """Adds ``embedding`` (array<float>), the hook for a sentence encoder."""
    return annotate(texts, load, "array<float>", text_col, "embedding")

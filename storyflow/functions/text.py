"""Text expressions. All are Columns, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Letters, digits and underscore in any script: the same set in Java and RE2.
WORD = r"\p{L}\p{N}_"
# Fixed value: a token, one character or more, hyphens allowed inside.
TOKEN = rf"[{WORD}](?:[{WORD}-]*[{WORD}])?"
# Marks that part list entries and texts.
ARRAY_MARK = "|||"
DOC_SEPARATOR = "<doc-sep>"


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def keep_prose_marks(c: Column) -> Column:
    """Drop punctuation other than ``' " $ £ € ; - : . ,`` and halve double spaces once."""
    kept = F.regexp_replace(c, rf"[^{WORD}\s\p{{Z}}'\"$£€;\-:.,]", "")
    return F.replace(kept, F.lit("  "), F.lit(" "))


def is_missing_text(c: Column) -> Column:
    return c.isNull() | (F.lower(c) == "nan") | (F.trim(F.regexp_replace(c, r"\s", " ")) == "")


def headline_key(c: Column) -> Column:
    """Lower case, punctuation gone but apostrophes kept: what the lexicon is matched on."""
    return F.regexp_replace(F.lower(c), rf"[^{WORD}\s']+", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


# What parts two tokens: no word character, no hyphen inside a token. Possessive at the end, else Java recurses once a turn of the group.
BETWEEN = rf"(?:[^{WORD}-]+|(?<![{WORD}-])-+|-+(?![{WORD}-]))++"


def token_stream(c: Column) -> Column:
    """Lower-case tokens in order, separated by one blank: one pass instead of a match per token."""
    return F.trim(F.regexp_replace(F.lower(c), BETWEEN, " "))


def tokens(c: Column, stop_words: Sequence[str] = ()) -> Column:
    parts = F.split(token_stream(c), " ")
    if stop_words:
        return F.filter(parts, lambda w: (w != "") & ~w.isin(*stop_words))
    return F.filter(parts, lambda w: w != "")


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and the blanks that follow."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.when(F.replace(c, F.lit(" "), F.lit("")) != "", c)


def after_bullet(c: Column) -> Column:
    return F.trim(F.element_at(F.split(c, "•", 2), -1))


def section_name(main: Column, sub: Column) -> Column:
    return F.concat_ws("/", F.replace(main, F.lit("+"), F.lit(" ")), sub)


def third_link_text(texts: Column) -> Column:
    """The third link's text; when there are fewer links, the first that is not empty."""
    return F.coalesce(F.try_element_at(texts, F.lit(3)),
                      F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def split_list(c: Column, mark: str = ",") -> Column:
    """Text to array; the empty text is the empty array."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "\\Q" + mark + "\\E"))


def join_list(c: Column, mark: str = ARRAY_MARK) -> Column:
    return F.array_join(c, mark)


def parse_list_literal(c: Column) -> Column:
    """``['a', 'b']`` as written by older exports → array; commas part the entries."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\[|\]", ""), "[\"']", "")
    return split_list(F.trim(F.regexp_replace(bare, r"\s*,\s*", ",")))


def model_score(confidence: Column, low: float = 0.5, high: float = 1.0, top: float = 2.0) -> Column:
    """Model confidence on the scale of the other signals; negative below ``low``."""
    return (confidence - low) / (high - low) * top


def clip_unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

"""Listing rows (one per article card or link): per-source tidying, filters, sections, first-seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


@dataclass(frozen=True)
class ListingRule:
    min_title: int = 0
    min_spaces: int = 0
    min_url: int = 0
    min_dashes: int = 0
    title_not_blank: bool = False
    need_url: bool = False
    url_not_blank: bool = False
    drop_url_prefix: str | None = None
    drop_url_part: str | None = None
    drop_title_parts: tuple[str, ...] = ()
    cut_from_title: str | None = None
    blank_subheading_to_null: bool = False
    subheading_after_bullet: bool = False
    first_seen_by: tuple[str, ...] = ()


# What counts as an article on the listings of each source.
LISTING_RULES = {
    "FOX": ListingRule(need_url=True, drop_url_prefix="https://www.foxnews.com/video",
                       drop_title_parts=("quiz", "political cartoons of the day")),
    "CNN": ListingRule(min_title=10, min_dashes=3, min_spaces=2, need_url=True, url_not_blank=True, drop_url_part="cnn.com/audio"),
    "WAPO": ListingRule(min_title=3, min_dashes=3, min_spaces=3, min_url=5, cut_from_title="\n"),
    "NYT": ListingRule(min_spaces=3, first_seen_by=("source", "url")),
    "AP": ListingRule(title_not_blank=True, blank_subheading_to_null=True, first_seen_by=("source", "url")),
    "NPR": ListingRule(title_not_blank=True, subheading_after_bullet=True, first_seen_by=("source", "section", "url")),
    "HuffPost": ListingRule(min_spaces=3, cut_from_title="Opinion:", first_seen_by=("source", "url")),
    "CBS": ListingRule(),
}


def _by_source(rules, make, default: Column) -> Column:
    out = None
    for name, rule in rules.items():
        value = make(rule)
        out = F.when(F.col("source") == name, value) if out is None else out.when(F.col("source") == name, value)
    return out.otherwise(default)


def tidy(listing: DataFrame, rules: dict[str, ListingRule] = LISTING_RULES) -> DataFrame:
    """Per-source clean-up of title and subheading."""
    title, sub = F.col("title"), F.col("subheading")

    def new_title(rule):
        if rule.cut_from_title is None:
            return title
        cut = F.replace(title, F.lit(rule.cut_from_title), F.lit(""))
        return cut if rule.cut_from_title.isspace() else F.trim(cut)

    def new_sub(rule):
        if rule.subheading_after_bullet:
            return T.after_bullet(sub)
        return T.blank_to_null(sub) if rule.blank_subheading_to_null else sub

    return listing.withColumns({"title": _by_source(rules, new_title, title), "subheading": _by_source(rules, new_sub, sub)})


def keep_articles(listing: DataFrame, rules: dict[str, ListingRule] = LISTING_RULES) -> DataFrame:
    """Rows that pass the filter of their source. A NULL title never passes."""
    title, url = F.col("title"), F.col("url")

    def passes(rule):
        ok = title.isNotNull()
        if rule.min_title:
            ok &= F.length(title) >= rule.min_title
        if rule.min_spaces:
            ok &= T.count_of(title, " ") >= rule.min_spaces
        if rule.min_url:
            ok &= F.length(url) >= rule.min_url
        if rule.min_dashes:
            ok &= T.count_of(url, "-") >= rule.min_dashes
        if rule.title_not_blank:
            ok &= F.replace(title, F.lit(" "), F.lit("")) != ""
        if rule.need_url:
            ok &= url.isNotNull()
        if rule.url_not_blank:
            ok &= ~url.isin("", " ")
        if rule.drop_url_prefix:
            ok &= ~url.startswith(rule.drop_url_prefix)
        if rule.drop_url_part:
            ok &= ~url.contains(rule.drop_url_part)
        for part in rule.drop_title_parts:
            ok &= ~F.lower(title).contains(part)
        return ok

    return listing.where(_by_source(rules, passes, F.lit(True)))


# ---------------------------------------------------------------- keep-first

def keep_first(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The first row of each key by ``order`` (unique). An aggregation, so copies of a hot
    key are dropped before the shuffle."""
    cols = rows.columns
    return rows.groupBy(*(F.col(k).alias(f"key_{n}") for n, k in enumerate(keys))).agg(
        F.min_by(F.struct(*cols), order).alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in cols))


def first_seen(listing: DataFrame, order: str = "pos", rules: dict[str, ListingRule] = LISTING_RULES) -> DataFrame:
    """Per source: once per url, once per section and url, or every row."""
    scope = _by_source(
        rules, lambda r: F.when(F.lit(bool(r.first_seen_by)), F.when(F.lit("section" in r.first_seen_by), F.col("section"))
                                .otherwise(F.lit(""))).otherwise(F.concat(F.lit("row "), F.col(order).cast("string"))),
        F.concat(F.lit("row "), F.col(order).cast("string")))
    return keep_first(listing.withColumn("scope", scope), ["source", "scope", "url"], order).drop("scope")


# ---------------------------------------------------------------- sections

@dataclass(frozen=True)
class SectionRule:
    stop_word: str | None = None
    stop_inclusive: bool = False       # the stop section itself is kept
    stop_at_repeat: bool = False
    skip_url_part: str | None = None
    skip_names: tuple[str, ...] = ()
    skip_name_parts: tuple[str, ...] = ()   # all of them present
    last_wins: bool = True


# Which navigation entries are sections.
SECTION_RULES = {
    "FOX": SectionRule(stop_at_repeat=True, last_wins=False),
    "CNN": SectionRule(stop_word="about"),
    "WAPO": SectionRule(),
    "NYT": SectionRule(skip_url_part="nytimes.com/spotlight/",
                       skip_names=("", " ", "Games", "Wirecutter", "Cooking", "Athletic")),
    "AP": SectionRule(stop_word="religion", stop_inclusive=True),
    "NPR": SectionRule(skip_url_part="codeswitch"),
    "HuffPost": SectionRule(stop_word="life", skip_name_parts=("20", "election")),
    "CBS": SectionRule(skip_name_parts=("sport",)),
}


def excluded_section(rule: SectionRule) -> Column:
    name, low, url = F.col("section"), F.lower("section"), F.col("url")
    out = F.lit(False)
    if rule.skip_url_part:
        out |= F.lower(url).contains(rule.skip_url_part)
    if rule.skip_names:
        out |= name.isin(*rule.skip_names)
    if rule.skip_name_parts:
        parts = F.lit(True)
        for part in rule.skip_name_parts:
            parts &= low.contains(part)
        out |= parts
    return F.coalesce(out, F.lit(False))


def sections_until(nav: DataFrame, rule: SectionRule, scope: list[str]) -> DataFrame:
    """(scope…, pos, section, url) up to the rule's end, exclusions dropped.

    The end is one minimum per scope, joined back: no sorted window over a long list. Needs no shuffle when ``nav`` is
    already partitioned by the scope.
    """
    rows = nav.where(~excluded_section(rule))
    if rule.stop_at_repeat:
        named = Window.partitionBy(*scope, "section")
        flagged = rows.where("section is not null").withColumn("first_pos", F.min("pos").over(named)).where("pos > first_pos").select(*scope, "pos")
    elif rule.stop_word:
        flagged = rows.where(F.lower("section").contains(rule.stop_word)).select(*scope, "pos")
    else:
        return rows
    end = flagged.groupBy(*scope).agg(F.min("pos").alias("end"))
    inside = F.col("end").isNull() | (F.col("pos") <= F.col("end") if rule.stop_inclusive else F.col("pos") < F.col("end"))
    return rows.join(end.hint("shuffle_hash"), scope, "left").where(inside).drop("end")  # so the rows are not sorted


def last_wins(nav: DataFrame, scope: list[str]) -> DataFrame:
    """One row per section name: the place of its first entry, the url of its last."""
    return nav.groupBy(*scope, "section").agg(F.min("pos").alias("pos"), F.max_by("url", "pos").alias("url"))


def sections(nav: DataFrame, rules: dict[str, SectionRule] = SECTION_RULES, scope: list[str] | None = None) -> DataFrame:
    """All sources' sections, each under its own rule."""
    scope = scope or ["source"]
    out = None
    for name, rule in rules.items():
        part = sections_until(nav.where(F.col("source") == name), rule, scope)
        part = last_wins(part, scope) if rule.last_wins else part
        part = part.select(*scope, "section", "pos", "url")
        out = part if out is None else out.unionByName(part)
    return out

"""Listing pages → one row a card: title, link, image, subheading and date, each by the rule of its source."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates as D, html as H


@dataclass(frozen=True)
class Field:
    """Where a card keeps a value: the ``nth`` element that ``opening`` matches, looked for inside the element ``inside`` if given.

    Its text, or its ``attribute``. ``or_first`` takes the first non-empty text where there is no nth; ``beside`` looks
    in the element around the card.
    """

    opening: str
    inside: str | None = None
    nth: int = 1
    attribute: str | None = None
    or_first: bool = False
    beside: bool = False


@dataclass(frozen=True)
class CardRule:
    card: str
    title: Field
    link: Field = Field(H.by_tag("a"), attribute="href")
    image: Field | None = Field(H.by_tag("img"), attribute="src")
    subheading: Field | None = None
    date: Field | None = None
    segment: str | None = None  # cards are those of the page's segments, of which the first few hold none
    skip_segments: int = 0


# The cards of each source's listings and what they hold.
CARD_RULES = {
    "FOX": CardRule(H.by_tag("article"), Field(H.by_tag("a"), nth=3, or_first=True), date=Field(H.by_class("time"))),
    "WAPO": CardRule(H.by_attribute("data-feature-id", "homepage/story"), Field(H.by_attribute("data-qa", "card-title")),
                     subheading=Field(H.by_tag("p"))),
    "NYT": CardRule(H.by_tag("article"), Field(H.by_tag("a")), subheading=Field(H.by_tag("p")),
                    date=Field(H.by_attribute("data-testid", "todays-date"), beside=True)),
    "AP": CardRule(H.by_class("PageList-items-item"), Field(H.by_class("PagePromoContentIcons-text")),
                   image=Field(H.by_tag("source"), attribute="srcset"), subheading=Field(H.by_class("PagePromoContentIcons-text"), nth=2),
                   segment=H.by_class("PageList-items"), skip_segments=2),
    "NPR": CardRule(H.by_class("item", "has-image"), Field(H.by_tag("a"), inside=H.by_class("title")),
                    link=Field(H.by_tag("a"), inside=H.by_class("title"), attribute="href"),
                    image=Field(H.by_tag("img"), inside=H.by_tag("picture"), attribute="src"),
                    subheading=Field(H.by_tag("a"), inside=H.by_class("teaser")),
                    date=Field(H.by_tag("time"), inside=H.by_class("teaser"), attribute="datetime")),
    "HuffPost": CardRule(H.by_class("card", "js-card"), Field(H.by_class("card__headline__text")), subheading=Field(H.by_class("card__description"))),
    "CBS": CardRule(H.by_tag("article"), Field(H.by_class("item__hed")), subheading=Field(H.by_class("item__dek")), date=Field(H.by_class("item__date"))),
}


class Element(NamedTuple):
    """An element of a page: its opening tag is ``page[start:body]``, its source ``page[start:end]``; ``up`` is the element around it."""

    name: str
    start: int
    body: int
    close: int  # where its end tag begins
    end: int
    up: int


TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)[^>]*>?")
HIDDEN = re.compile(H.SCRIPT)


def scan(page: str) -> list[Element]:
    """All elements of a page in order of their opening tags, by one pass over its tags.

    An end tag ends the nearest open element of its name and what was left open inside; one without such an element is passed over.
    Elements left open run to the end of the page, tags without an end tag are elements of their own.
    """
    starts, names, bodies, ups, closes, ends = [], [], [], [], [], []
    stack: list[int] = []
    open_by_name: dict[str, int] = {}
    for m in TAG.finditer(page):
        name = m[2].lower()
        if not m[1]:
            n = len(starts)
            for held, value in ((starts, m.start()), (names, name), (bodies, m.end()), (ups, stack[-1] if stack else -1), (closes, m.end()), (ends, m.end())):
                held.append(value)
            if name not in H.VOID:
                stack.append(n)
                open_by_name[name] = open_by_name.get(name, 0) + 1
        elif open_by_name.get(name):
            while True:
                n = stack.pop()
                open_by_name[names[n]] -= 1
                closes[n], ends[n] = m.start(), m.start()
                if names[n] == name:
                    ends[n] = m.end()
                    break
    for n in stack:
        closes[n] = ends[n] = len(page)
    return list(map(Element, names, starts, bodies, closes, ends, ups))


def matching(page: str, tree: list[Element], opening: re.Pattern, within: int = -1) -> list[int]:
    """Numbers of the elements that ``opening`` matches, of the whole page or inside one element."""
    first, last = within + 1, len(tree)
    if within >= 0:
        last = bisect_left(tree, tree[within].end, lo=first, key=lambda e: e.start)
    return [n for n in range(first, last) if opening.match(page, tree[n].start, tree[n].body)]


def value(page: str, tree: list[Element], card: int, field: Field | None) -> str | None:
    """A field of a card: the source of the element it is in, or the value of its attribute; none if the card does not hold it."""
    if field is None or (field.beside and tree[card].up < 0):
        return None
    scope = tree[card].up if field.beside else card
    if field.inside:
        scope = next(iter(matching(page, tree, _pattern(field.inside), scope)), None)
        if scope is None:
            return None
    found = matching(page, tree, _pattern(field.opening), scope)
    if field.or_first and len(found) < field.nth:
        found = [n for n in found if re.sub(r"<[^>]*>|\s", "", page[tree[n].body : tree[n].close])][:1] * field.nth
    if len(found) < field.nth:
        return None
    e = tree[found[field.nth - 1]]
    if not field.attribute:
        return page[e.body : e.close]
    m = _attribute(field.attribute).search(page, e.start, e.body)
    return m and (m[1] or m[2] or m[3])


@cache
def _pattern(opening: str) -> re.Pattern:
    return re.compile(opening)


@cache
def _attribute(name: str) -> re.Pattern:
    return re.compile(rf"""[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


FIELDS = ("title", "link", "image", "subheading", "date")


def cards_of(page: str, rule: CardRule) -> list[tuple[str | None, ...]]:
    """The fields, as they stand in the source, of every card of a page."""
    page = HIDDEN.sub("", page)
    tree = scan(page)
    scopes = matching(page, tree, _pattern(rule.segment))[rule.skip_segments :] if rule.segment else [-1]
    cards = dict.fromkeys(n for s in scopes for n in matching(page, tree, _pattern(rule.card), s))  # segments may lie in each other
    return [tuple(value(page, tree, n, getattr(rule, name)) for name in FIELDS) for n in cards]


def split_cards(pages: DataFrame, rules: dict[str, CardRule] = CARD_RULES) -> DataFrame:
    """``pages`` (source, html and more) with a row a card in place of ``html``: ``pos`` counts the cards of a page from 0, then come
    the fields as they stand in the source. Pages without html or of unknown sources give none.

    A page's tags nest to any depth, so it is scanned once by a small function over Arrow batches, not by expressions.
    """
    keep = [f for f in pages.schema.fields if f.name != "html"]
    out = T.StructType([*keep, T.StructField("pos", T.IntegerType()), *(T.StructField(name, T.StringType()) for name in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, values = [], [], []
            for n, (source, html) in enumerate(zip(batch.column("source").to_pylist(), batch.column("html").to_pylist())):
                if source in rules and html:
                    found = cards_of(html, rules[source])
                    rows += [n] * len(found)
                    places += range(len(found))
                    values += found
            of_field = [[v[k] for v in values] for k in range(len(FIELDS))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).take(pa.array(rows, pa.int64())) for f in keep), pa.array(places, pa.int32()),
                 *(pa.array(v, pa.string()) for v in of_field)], names=out.names)

    return pages.mapInArrow(run, out)


def listing_cards(pages: DataFrame, as_of: Column, rules: dict[str, CardRule] = CARD_RULES) -> DataFrame:
    """``pages``: source, section, section_url (the address of the page), html and more. A row for each card with a title and a link.

    Adds pos, title, url (absolute), date, image and subheading; ``tidy``, ``keep_articles`` and ``first_seen`` of
    ``listing.py`` go on from here.
    """
    rows = split_cards(pages, rules).where("title IS NOT NULL AND link IS NOT NULL")
    texts = rows.withColumns({name: H.plain(F.col(name)) for name in ("title", "subheading", "date")})
    return texts.withColumns({
        "link": H.absolute(F.col("link"), F.col("section_url")), "date": D.by_source(F.col("source"), F.col("date"), as_of)}).withColumnRenamed("link", "url")

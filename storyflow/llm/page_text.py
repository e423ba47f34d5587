"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; what page furniture holds (menus, forms, adverts, comments) gives
no line. The text lengths, without link texts, are summed over sliding windows of lines. Where the sum first rises over
a share of its peak is a surge, where it falls to nothing a dive; the stretch with most text between the two is the
core. The element that encloses the core closes the gap at both ends, so short first and last paragraphs stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices, texts

WINDOW = 3  # lines summed at each place
SURGE = 0.2  # of the highest sum, from which a stretch of text begins

TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math|select|object|canvas)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<[/!?a-zA-Z][^>]*+>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
SINGLE = frozenset("area base br col embed hr img input link meta param source track wbr p li dt dd tr td th option".split())
FURNITURE = frozenset("nav aside footer header form menu dialog button fieldset head".split())
# Words of class, id or role that name page furniture.
NAMED = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright dialog disqus footer gdpr header login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices pager pagination popup privacy promo promoted promotion recommended related "
    "reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget widgets".split())


def _furniture(tag: str, attributes: str) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag in FURNITURE:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif not NAMED.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


class _Element:
    __slots__ = ("tag", "furniture", "first", "last", "holds_main", "up")

    def __init__(self, tag: str, furniture: bool, first: int, up: "_Element | None"):
        self.tag, self.furniture, self.first, self.last, self.holds_main, self.up = tag, furniture, first, -1, False, up


def _lines(page: str) -> tuple[list[str], list[int], list[_Element]]:
    """(texts of all blocks in page order, characters of them inside links, elements with their range of lines)."""
    lines, linked, elements = [], [], []
    piece, in_link, link_chars = [], False, 0
    top = _Element("html", False, 0, None)
    open_ = [top]
    at = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            piece.append(raw)
            link_chars += len(raw) if in_link else 0

    def end_block() -> None:
        nonlocal link_chars
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                lines.append(text)
                linked.append(min(link_chars, len(text)))
            piece.clear()
        link_chars = 0

    for m in TAGS.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            piece.append(" ")
        elif tag == "a":
            in_link = not m[2]
        elif tag not in INLINE:
            end_block()
            in_link = False
            if tag == "h1" and not m[2]:  # a headline keeps what is around it; in a page header only inside an article
                for k, e in enumerate(open_):
                    e.holds_main |= e.tag not in FURNITURE or any(x.tag in ("article", "main") for x in open_[:k])
            if tag in SINGLE:
                continue
            if m[2]:
                if any(e.tag == tag for e in open_[1:]):
                    while len(open_) > 1:
                        e = open_.pop()
                        e.last = len(lines)
                        if e.tag == tag:
                            break
            elif not m[4].endswith("/"):
                e = _Element(tag, _furniture(tag, m[4]), len(lines), open_[-1])
                if tag in ("article", "main") and not e.furniture and not any(x.furniture and not x.holds_main for x in open_):
                    for x in open_:
                        x.holds_main = True
                open_.append(e)
                elements.append(e)
    add(page[at:])
    end_block()
    for e in open_:
        e.last = len(lines)
    return lines, linked, [top, *elements]


def main_text(page: str) -> str:
    lines, linked, elements = _lines(page)
    if not lines:
        return ""
    keep = np.ones(len(lines), bool)
    for e in elements:
        if e.furniture and not e.holds_main:
            keep[e.first : e.last] = False
    bodies = [e for e in elements if e.tag in ("article", "main") and not e.furniture and keep[e.first : e.last].any()]
    inside = np.zeros(len(lines), bool)
    for e in bodies:
        inside[e.first : e.last] = True
    if bodies:
        keep &= inside
    size = np.where(keep, np.array([len(t) for t in lines]) - np.array(linked), 0)
    place = np.flatnonzero(keep)
    if not len(place):
        return ""
    # Sums over windows of the lines that are left; the text between a surge and the next dive is a stretch.
    sums = np.convolve(size[place], np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    if sums.max() <= 0:
        first, last = place[0], place[-1] + 1
    else:
        best, start, total = (-1, 0, len(place)), None, 0
        limit = SURGE * sums.max()
        for k, s in enumerate([*sums, 0]):
            if start is None and s >= limit:
                start, total = k, 0
            elif start is not None and s <= 0:
                best, start = max(best, (total, -start, k)), None
            if start is not None and k < len(place):
                total += int(size[place[k]])
        first, last = place[-best[1]], place[best[2] - 1] + 1
    around = min((e for e in elements if e.first <= first and e.last >= last and not (e.furniture and not e.holds_main)),
                 key=lambda e: (e.last - e.first, e.tag not in ("article", "main")), default=elements[0])
    whole = next((b for b in bodies if b.first <= first and b.last >= last), around)
    chosen = [i for i in place.tolist() if whole.first <= i < whole.last and (whole.tag in ("article", "main") or 2 * linked[i] <= len(lines[i]))]
    return " ".join(lines[i] for i in chosen)


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """``keep`` columns and the main text of every page; empty if there is none.

    Null and empty pages give the empty text; a page without markup is one line and is kept; pages of any length are
    read whole; repeated rows stay. Other columns are left out, so their names cannot clash.
    """
    rows = pages.select(*(F.col(k).alias(f"__{n}") for n, k in enumerate(keep)), F.col(page).alias("__page"))
    names = [f"__{n}" for n in range(len(keep))]
    out = T.StructType([*rows.drop("__page").schema.fields, T.StructField("__text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__page"):
            found = pa.array([main_text(p) for p in texts(batch.column("__page"))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, "__text"])

    done = rows.mapInArrow(run, out)
    return done.select(*(F.col(c).alias(k) for c, k in zip(names, keep)), F.col("__text").alias(text))

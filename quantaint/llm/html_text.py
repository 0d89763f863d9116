"""Main text of web pages from the ratio of text to tags.

Events of the standard library's parser run through a page once. They cut it into lines, one a
block, and leave out what the markup itself calls a menu, header, footer, sidebar, notice, advert,
form, script, style or comment. Each line has its ratio of text to tags; a Gaussian window smooths
the ratios along the page, and lines above a threshold taken from their spread are content. What
is returned are whole regions: every line of an article or container that holds content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaint.llm.batches import keep_texts

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements whose text is never content.
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form fieldset button select textarea label "
    "iframe object svg math canvas audio video dialog menu".split()
)
# Words of a class, id or role that name such a part of a page.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs toolbar pager pagination sidebar aside complementary widget "
    "header masthead footer contentinfo copyright cookie cookies consent gdpr notice notices alert popup overlay modal "
    "dialog newsletter subscribe subscription signup login search form comment comments commentlist disqus discussion "
    "replies reply respond share sharing social related recommended recommendations".split()
)
# Words that turn the meaning of such a name round: "with-sidebar", "ad-free".
_OTHER = frozenset("has with no not without free".split())
# Inside an article a header holds its headings.
_HEADINGS = frozenset(("header", "masthead"))
# Containers that hold a page's main text by definition.
_MAIN = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements inside a line; every other tag starts a new one.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# Elements that hold a line or a part of one, no region of their own.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl pre blockquote figure figcaption td th tr tbody thead tfoot caption hgroup address".split())


class Line:
    __slots__ = ("parts", "tags", "linked", "region")

    def __init__(self, region: int) -> None:
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.region = region


class Lines(HTMLParser):
    """Cuts a page into lines by the parser's events.

    ``mains`` are the regions of articles; a region is numbered by the order in which its
    container opens, and 0 is the page itself. Only blocks are nested here; an inline element
    counts as a tag, and one whose text is left out lasts to its end tag or its block's.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.mains: set[int] = set()
        # (tag, region, whether its text is left out, whether it lies in an article)
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.opened: Counter[str] = Counter()
        # Inline element left out: its tag, how often it is open, and the depth of its block.
        self.skipped, self.skips, self.skip_depth = "", 0, 0
        self.links = 0
        self.regions = 0
        self.line = Line(0)

    def _cut(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(self.open[-1][1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.line.parts.append(" ")
        if tag in _INLINE:
            self.line.tags += 1
            self.links += tag == "a"
            if self.skips:
                self.skips += tag == self.skipped
            elif tag not in _VOID and attrs and self._dropped(tag, attrs, self.open[-1][3]):
                self.skipped, self.skips, self.skip_depth = tag, 1, len(self.open)
            return
        if tag in _VOID:
            if tag == "hr":
                self._cut()
            return
        if self.open[-1][0] == "p":
            self._end()  # a paragraph holds no block
        _, region, out, inside = self.open[-1]
        # A main element ends what the names of its containers said.
        out = tag != "main" and (out or self._dropped(tag, attrs, inside))
        if not out and tag not in _LEAF and not inside:
            self.regions += 1
            region = self.regions
            if tag in _MAIN:
                self.mains.add(region)
                inside = True
        self.open.append((tag, region, out, inside))
        self.opened[tag] += 1
        self._cut()
        self.line.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag in _INLINE:
            self.links -= tag == "a" and self.links > 0
            self.skips -= self.skips > 0 and tag == self.skipped
            return
        if self.opened[tag]:
            # Whatever was left open inside ends with it.
            while self._end() != tag:
                pass
        self._cut()

    def _end(self) -> str:
        tag = self.open.pop()[0]
        self.opened[tag] -= 1
        if len(self.open) < self.skip_depth:
            self.skips = self.skip_depth = 0
        return tag

    def handle_data(self, data: str) -> None:
        if self.open[-1][2] or self.skips:
            return
        self.line.parts.append(data)
        if self.links:
            self.line.linked += len(data)

    def close(self) -> None:
        super().close()
        self._cut()

    @staticmethod
    def _dropped(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        if tag in DROPPED or (tag == "header" and not inside):
            return True
        if tag in ("html", "body"):
            return False
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return True
            if key in ("class", "id", "role") and value:
                for name in value.split():
                    words = {w.lower() for w in _NAME.findall(name)}
                    if inside:
                        words -= _HEADINGS
                    if not words.isdisjoint(DROPPED_NAMES) and words.isdisjoint(_OTHER):
                        return True
        return False


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian window of ``radius`` lines on each side; at the ends, over the lines there are."""
    if not len(ratios):
        return ratios
    weights = np.array([exp(-(i * i) / (2 * max(radius, 1))) for i in range(-radius, radius + 1)])
    total = np.convolve(ratios, weights)[radius : radius + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[radius : radius + len(ratios)]


def threshold(ratios: np.ndarray) -> float:
    """Where lines fall into two clusters: the midpoint between the two means (2-means from the extremes)."""
    low, high = float(ratios.min()), float(ratios.max())
    while low < high:
        cut = (low + high) / 2
        upper = ratios >= cut
        means = float(ratios[~upper].mean()), float(ratios[upper].mean())
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by empty lines; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    texts, kept = [], []
    for line in parser.lines:
        text = _SPACE.sub(" ", "".join(line.parts)).strip(" ")
        if text:
            texts.append(text)
            kept.append(line)
    if not kept:
        return ""
    regions = [line.region for line in kept]
    if not parser.mains.isdisjoint(regions):
        # Text outside articles is no part of one.
        texts = [t for t, r in zip(texts, regions, strict=True) if r in parser.mains]
        kept = [line for line in kept if line.region in parser.mains]
        regions = [line.region for line in kept]
    plain = [max(0, len(t) - line.linked) for t, line in zip(texts, kept, strict=True)]
    ratios = smoothed(np.array([n / max(1, line.tags) for n, line in zip(plain, kept, strict=True)], float))
    cut = threshold(ratios)
    content = {r for r, ratio in zip(regions, ratios, strict=True) if ratio >= cut}
    return "\n\n".join(t for t, r in zip(texts, regions, strict=True) if r in content)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    Null and empty html give an empty text, as do pages of menus and scripts alone. Markup that is
    never closed ends with its container or the page; a page of any length is read whole. Repeated
    rows stay repeated, null ids and urls stay null, an empty table gives no rows, and other
    columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    types = narrow.schema["page_id"].dataType.simpleString()
    found = keep_texts(narrow.mapInArrow(run, f"page_id {types}, url string, text string"), "page-texts")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))

"""HTML extraction: streaming parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's parser sends events; a block element's bounds end a line, so a line is a block of text
whatever the line breaks of the source. Lines belong to regions: the innermost container (article, main, section, div,
list, table cell and the like).

1. A line's ratio is its text outside links over its tags. Hints scale it: lines in menus, forms, footers, asides and
   in what class, id or role call an advert, a notice, comments and the like have 0; where the page has an article or
   main element, lines outside it have a tenth.
2. The ratios are smoothed along the page by a Gaussian, over the lines without such a mark, in and outside the article
   apart, so that a heading or a short paragraph is carried by its neighbours.
3. The smoothed ratios are split into two clusters on a logarithmic scale, which gives the threshold.
4. A region is content if most of its text lies in lines at or above the threshold. A region inside a content region
   or inside an article is content too unless it is marked or mostly links: lists, captions, notes. The region with
   the most text above the threshold always is. All lines of a content region are kept, short ones too.

References are decoded, white space in a block becomes one space, blocks are trimmed and joined by two line breaks in
page order. Null or empty html, and pages without text, give an empty text. Cut-off pages are read as far as they go;
the work grows in proportion to the page, however long and however deeply nested. Ties: of regions with equally much
text the first counts as the largest. Repeated rows are kept, a null page_id or url stays null; other columns are
ignored; no pages give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import map_arrow, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
SPACED = frozenset(["br", "td", "th", "img", "wbr"])
#: Elements whose text is no text of the page.
NEVER = frozenset("audio button canvas datalist embed head iframe input math noscript object option script select style svg template textarea title video".split())
#: Elements that mark their lines as no article text.
MARK = frozenset("aside dialog footer form label menu nav search".split())
#: Words in class or id that mark a part as no article text, and roles that do.
HINTS = frozenset("ad ads adbox adsense advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs byads comment commentlist comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ARTICLE = frozenset(["article", "main"])
CONTAINER = frozenset("article body center div dl main ol section table td ul".split())
#: What is left of a ratio outside the article of a page that has one.
OUTSIDE = 0.1
_TOKEN = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Region:
    """A container: its parent (none for what isn't inside a container or body), and whether it is in an article."""

    def __init__(self, parent: Region | None, article: bool):
        self.parent, self.article = parent, article
        self.text = self.high = self.own = 0  # characters: all, in lines above the threshold, unmarked outside links


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    marked: bool
    region: Region


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, Region]] = []  # tag, and never, marked, region outside it
        self.count: Counter[str] = Counter()  # of the open tags
        self.never = self.marked = False
        self.region = Region(None, False)
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.marked, self.region))
            self.parts.clear()
        self.tags = self.linked = 0

    def hinted(self, tag: str, attrs: list) -> bool:
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v and v.lower() in ROLES:
                return True
            if k in ("class", "id") and v and tag not in ("body", "html", "main"):
                words = {x.lower() for x in _TOKEN.findall(v)}
                if words & HINTS if tag != "article" else words & {"comment", "reply", "ad", "advert", "promo", "sponsored"}:
                    return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.end_line()
            if self.open and self.open[-1][0] == "p" or tag == "li" and self.open and self.open[-1][0] == "li":
                self.close_last()
        elif tag in SPACED:
            self.parts.append(" ")
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in VOID:
            return
        if tag in BLOCK or tag in NEVER or tag in MARK or tag in CONTAINER or attrs:
            if tag in ARTICLE:
                while self.open and self.open[-1][0] in ("nav", "ul", "li"):  # a menu that was never closed
                    self.close_last()
            never = self.never or tag in NEVER
            marked = self.marked or tag in MARK or tag == "header" and not self.region.article or bool(attrs) and self.hinted(tag, attrs)
            if marked != self.marked:
                self.end_line()
            self.open.append((tag, self.never, self.marked, self.region))
            self.count[tag] += 1
            if tag in CONTAINER or marked and not self.marked:
                self.region = Region(self.region if tag != "body" else None, self.region.article or tag in ARTICLE)
            self.never, self.marked = never, marked

    def close_last(self) -> None:
        tag, never, marked, region = self.open[-1]
        if region is not self.region or marked != self.marked:
            self.end_line()
        self.open.pop()
        self.count[tag] -= 1
        self.never, self.marked, self.region = never, marked, region

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        elif tag in SPACED:
            self.parts.append(" ")
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.count[tag]:
            while self.open[-1][0] != tag:
                self.close_last()
            self.close_last()

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def ratios(lines: list[Line]) -> np.ndarray:
    """Text outside links over tags, as the hints scale it."""
    article = any(x.region.article and not x.marked for x in lines)
    scale = [0.0 if x.marked else OUTSIDE if article and not x.region.article else 1.0 for x in lines]
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]) * scale


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian weights over neighbouring lines, scaled at the page's ends to those that are there."""
    if not len(x):
        return x
    reach = max(1, int(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(x))
    return np.convolve(x, w)[cut] / np.convolve(np.ones(len(x)), w)[cut]


def threshold(x: np.ndarray) -> float:
    """The split of values into two clusters with the least spread inside both, on a logarithmic scale."""
    y = np.sort(np.log1p(x))
    n = len(y)
    if n < 2 or y[-1] - y[0] < 1.0:  # one cluster, of text if it has any
        return max(float(x.min(initial=np.inf)), 1e-9)
    s = np.cumsum(y)
    i = np.arange(1, n)
    between = i * (n - i) * (s[:-1] / i - (s[-1] - s[:-1]) / (n - i)) ** 2
    k = int(between.argmax())
    return float(np.expm1((y[k] + y[k + 1]) / 2))


def content(lines: list[Line], sigma: float) -> list[Line]:
    """The lines of the content regions."""
    ratio, free, inner = ratios(lines), np.array([not x.marked for x in lines]), np.array([x.region.article for x in lines])
    smooth = ratio.copy()
    for some in (free & inner, free & ~inner):
        smooth[some] = smoothed(ratio[some], sigma)
    high = smooth >= threshold(smooth)
    for x, up in zip(lines, high.tolist(), strict=True):
        x.region.text += len(x.text)
        x.region.high += len(x.text) * up
        x.region.own += 0 if x.marked else max(0, len(x.text) - x.linked)
    regions = list(dict.fromkeys(x.region for x in lines))
    largest = max(regions, key=lambda r: (r.high if r.own else 0, r.own))
    keep = {r: True for r in regions if 2 * r.high > r.text or r is largest and r.own}
    keep[None] = False

    def inside(r: Region) -> bool:
        """Whether a region above is content; found once for each region."""
        path, up = [], r.parent
        while up is not None and up not in keep and up not in above:
            path.append(up)
            up = up.parent
        found = keep[up] if up in keep else above[up]
        above.update(dict.fromkeys(path, found))
        return found

    above: dict[Region | None, bool] = {}
    more = [r for r in regions if r not in keep and 2 * r.own > r.text and (r.article or inside(r))]
    keep.update(dict.fromkeys(more, True))
    return [x for x in lines if x.region in keep]


def main_text(html: str, sigma: float = 1.0) -> str:
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    return "\n\n".join(x.text for x in content(p.lines, sigma)) if p.lines else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(x.as_py() or "") for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), scan, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

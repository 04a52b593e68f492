"""Main text of web pages by text-to-tag ratio.

A page streams through the standard library's parser. Its events fill lines (one per block of the page),
each with its text, how much of that is links, and the number of tags in it. The logarithm of the ratio of
unlinked text to tags per line is smoothed by a Gaussian and split in two clusters by a threshold; lines of
the upper cluster are content, and a region that has such a line is a content region. What a page says of
itself bounds the regions: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are never content and count as lines without text. A marked article is one region, whose
short lines belong to it, but for lists of links in the lower cluster; of several articles, only those with a
line in the upper cluster count. Elsewhere boilerplate and lists of links part the regions, and a region
reaches from its first line in the upper cluster, and a heading above it, to its last.

Defined results: null and empty pages have empty text and n_chars 0; rows alike give alike rows; an
empty table gives no rows; further columns are ignored. Nothing is cut off, however long the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table

#: Fixed values of HTML: elements without an end tag, elements that break a line, elements that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("nav footer aside form script style noscript template head title svg math iframe object select button textarea dialog menu canvas audio video".split())
ENDS_P = BLOCK - frozenset(["br", "body", "html", "head", "title", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"])
#: Words of class, id and role that name boilerplate.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar header masthead footer sidebar side aside widget complementary contentinfo search cookie cookies consent notice notices notification alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion pagination pager skip hidden".split()
)
STICKY = frozenset("aside noscript template dialog head script style".split())
STICKY_WORDS = frozenset("comment comments commentlist disqus respond replies related recommended recommendations".split())
MAIN = frozenset(["article", "main"])
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
#: Width of the Gaussian in lines, and lines of links in a row that make a list.
SIGMA, LIST = 1.0, 3


class Lines(HTMLParser):
    """Parser events to lines: text, tags, grade of boilerplate, the number of the article they stand in (0: none), linked characters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Of the boilerplate grades 0 is none; an article inside grade 1 counts, one inside grade 2 doesn't.
        self.rows: list[tuple[str, int, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.open: list[tuple[str, int, int]] = []  # element, grade of boilerplate, article
        self.places: dict[str, list[int]] = {}  # of the open elements of each name
        self.mains: list[int] = []  # and of those that an end tag inside them doesn't reach beyond
        self.articles = 0

    def _line(self) -> None:
        if self.text or self.tags:
            _, bad, article = self.open[-1] if self.open else ("", 0, 0)
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.rows.append((text, self.tags, bad, article, min(len(text), self.linked)))
                self.tags = self.linked = 0
            self.text = []

    def _close(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in MAIN:
                self.mains.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ENDS_P:
            for k in range(len(self.open) - 1, max(-1, len(self.open) - 9), -1):
                if self.open[k][0] == "p":
                    self._close(k)
                    break
                if self.open[k][0] in BLOCK:
                    break
        elif tag == "body":
            self._close(0)
        _, bad, article = self.open[-1] if self.open else ("", 0, 0)
        if tag in MAIN and not article:
            if bad == 1:  # an article is no part of a menu that was left open before it
                bad = 0
            self.articles += 1
            article = self.articles
        if bad < 2:
            own = 2 if tag in STICKY else 1 if tag in NEVER or tag == "header" and not article else 0
            bad = max(bad, own, self._named(tag, attrs, article) if attrs else 0)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in MAIN:
            self.mains.append(len(self.open))
        self.open.append((tag, bad, article))

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]], article: int) -> int:
        """The grade that class, id, role and style give. An article's own header holds its title."""
        grade = 0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower():
                grade = 2
            elif name in ("class", "id", "role") and value and tag not in ("body", "html", "main"):
                for part in value.split():
                    words = {w.lower() for w in _WORD.findall(part)}
                    if words & STICKY_WORDS:
                        grade = 2
                    elif tag != "article" and not words & {"has", "with", "no"} and (words - {"header"} if article else words) & BOILER:
                        grade = max(grade, 1)
        return grade

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._line()
        self.tags += 1
        if not (at := self.places.get(tag)):
            return
        if self.mains and at[-1] < self.mains[-1] and tag not in ("body", "html"):
            return  # an end tag in an article closes nothing outside of it
        self._close(at[-1])

    def handle_data(self, data: str) -> None:
        # script and style never hold text; their content is data to the parser
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.text.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._line()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """values convolved with a Gaussian; at the ends the weights that are there are used."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[r : r + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[r : r + len(values)]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which of the values are in the upper one of two clusters: the threshold lies midway between their means."""
    lo, hi = float(values.min()), float(values.max())
    if hi <= 2 * lo:
        return np.ones(len(values), bool)
    for _ in range(50):
        cut = (lo + hi) / 2
        up = values > cut
        new = float(values[~up].mean()), float(values[up].mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return values > (lo + hi) / 2


def _in_lists(links: np.ndarray, least: int = LIST) -> np.ndarray:
    """Which lines stand in a run of `least` lines of links or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], links.astype(np.int8), [0]])))
    out = np.zeros(len(links), bool)
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        out[a:b] = b - a >= least
    return out


def selected(rows: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """Which lines are content."""
    size, tags, linked = (np.array([f(x) for x in rows], float) for f in (lambda x: len(x[0]), lambda x: x[1], lambda x: x[4]))
    bad = np.array([x[2] > 0 for x in rows])
    article = np.array([x[3] for x in rows])
    ratio = np.log1p((size - linked) / np.maximum(1, tags))
    up = upper_cluster(smoothed(np.where(bad, 0.0, ratio))) & ~bad
    links = _in_lists((2 * linked > size) & ~bad)
    if (marked := (article > 0) & ~bad).any():
        with_content = np.unique(article[up & marked])
        return marked & (np.isin(article, with_content) if len(with_content) else True) & ~(links & ~up)
    take = np.zeros(len(up), bool)
    region = np.cumsum(bad | links)
    for k in np.unique(region[up & ~links]).tolist():
        on = np.flatnonzero(up & ~links & (region == k))
        take[on[0] : on[-1] + 1] = True
        if on[0] and not (bad | links)[on[0] - 1]:  # a heading just above the region belongs to it
            take[on[0] - 1] = True
    return take


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    if not p.rows:
        return ""
    return " ".join(t for (t, *_), ok in zip(p.rows, selected(p.rows), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["_sk_html"]]
            out = b[["page_id", "url"]].assign(text=texts)
            yield out.assign(n_chars=[len(t) for t in texts])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("_sk_html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

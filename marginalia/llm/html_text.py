"""Main text of web pages by text-to-tag ratio.

The standard library's parser is fed in pieces and its events build the page's lines, one a block element. A line's ratio
is its text outside links over its tags, up to ``CAP``. What elements and classes tell adjusts the ratio and nothing else:
navigation, notices, adverts, forms and the like divide it by ``STRONG``, a word that is only part of a class by ``WEAK``, and
standing outside a page's articles by ``OUTSIDE``; an article's lines start from ``IN_ARTICLE`` characters, so short ones
count as well, and other lines without links from ``PLAIN``.

The ratios are smoothed with a Gaussian over the page order, no line to more than ``LIFT`` times its own ratio, and split into
two clusters at the threshold that parts their logarithms best; the lines of the higher cluster are the content. A page whose
every line is marked as something else has none.

A word that is only part of a class (``category-social``, ``layout-with-sidebar``) says nothing about an article or main
element that stands on its own, nor about an element that holds most of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, text_or_empty

PIECE = 1 << 16
SIGMA = 1.0
APART = 3.0
#: A line of this many characters a tag is as much content as any.
CAP = 40.0
#: Divisors of the ratio.
STRONG, WEAK, OUTSIDE = 100.0, 40.0, 20.0
#: Characters that lines start from.
IN_ARTICLE, PLAIN = 40, 10
LIFT = 3.0
#: Articles that hold less of a page's text than this don't make the rest stand outside.
ARTICLE_SHARE = 1 / 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never content.
DROP = frozenset("script style noscript template head title nav footer aside menu dialog form button select textarea fieldset iframe object svg math canvas audio video map datalist".split())
REGION = frozenset(("article", "main"))
#: Words of class and id values that mark what is not content.
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent dialog feedback paywall disqus disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications pagination pager popup popups promo promoted promotion promotions related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status note".split())
#: Of those the ones that may hold an article's own headings.
HEADER_WORDS = frozenset(("header", "masthead"))
#: A class with one of these in front tells of something elsewhere on the page.
_ABOUT = re.compile(r"(?:has|with|no|without|hide|show)[-_]|.*[-_](?:open|closed|enabled|disabled|free|off)$", re.I)
#: Of the words those whose elements may well hold more text than the content.
LONG_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    marked: bool  # surely no content
    region: int  # number of the article, 0 outside
    doubt: int  # number of the innermost element marked by a part of a class, 0 if none


class Open(NamedTuple):
    """An open element and what holds inside it."""

    tag: str
    region: int
    doubt: int
    marked: bool
    other: bool  # within its article, something that keeps no headings either
    alien: bool  # in comments, widgets and the like, where an article is none of the page's own


_OUTERMOST = Open("", 0, 0, False, False, False)


def _marked(attrs: list[tuple[str, str | None]]) -> tuple[str | None, str]:
    """What marks an element as no content (``header`` if that alone does, else ``other``), and if a ``whole`` class or
    attribute says so, or a ``part`` of a class, or one of the ``long`` words in a part."""
    found, how = None, "part"
    for name, value in attrs:
        if name in ("class", "id") and value:
            for part in value.split():
                words = set() if _ABOUT.match(part) else {w.lower() for w in _WORDS.findall(part)} & DROP_WORDS
                if not words:
                    continue
                found = "other" if words - HEADER_WORDS else found or "header"
                if part.lower() in DROP_WORDS:
                    how = "whole"
                elif words & LONG_WORDS and how == "part":
                    how = "long"
        elif (name == "role" and (value or "").lower() in DROP_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "other", "whole"
    return found, how


class Lines(HTMLParser):
    """Collects the lines of a page. Every event takes constant time, but for the elements it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents = [0]  # of doubts: the doubt around each
        self._open: list[Open] = []
        self._at: dict[str, list[int]] = {}  # where each tag is open
        self._blocks: list[int] = []
        self._borders: list[int] = []  # where articles are open
        self._parts: list[str] = []
        self._tags = self._linked = self._regions = 0

    def _state(self) -> Open:
        return self._open[-1] if self._open else _OUTERMOST

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            here = self._state()
            self.lines.append(Line(text, self._tags, self._linked, here.marked, here.region, here.doubt))
            self._tags = self._linked = 0
        self._parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCK:
            self._flush()
            self._close_implied(tag)
        elif tag == "br":
            self._parts.append(" ")
        if tag not in VOID:
            self._push(self._inside(tag, attrs))

    def _inside(self, tag: str, attrs: list[tuple[str, str | None]]) -> Open:
        here = self._state()
        why, how = _marked(attrs) if attrs and tag not in ("html", "body") else (None, "")
        if tag in REGION and how != "whole" and not here.region and not here.alien:
            why = None  # part of a class tells of a comment only in an article or in what is marked
        if tag in REGION and not why:
            # An article stands on its own even where an element before it was never closed; inside comments it is one.
            if here.region:
                return here._replace(tag=tag)
            self._regions += 1
            return Open(tag, self._regions, 0, False, False, here.alien)
        if tag in DROP or tag == "header":
            return here._replace(tag=tag, marked=True, other=here.other or tag in DROP or why == "other")
        if why and how == "part":
            self.parents.append(here.doubt)
            return here._replace(tag=tag, doubt=len(self.parents) - 1, other=here.other or why == "other")
        if why:
            return here._replace(tag=tag, marked=True, other=here.other or why == "other", alien=True)
        if tag in _HEADINGS and here.region and not here.other:
            return here._replace(tag=tag, marked=False, doubt=0)  # an article's own header keeps its headings
        return here._replace(tag=tag)

    def _push(self, element: Open) -> None:
        at = len(self._open)
        self._open.append(element)
        self._at.setdefault(element.tag, []).append(at)
        if element.tag in BLOCK:
            self._blocks.append(at)
        if element.tag in REGION:
            self._borders.append(at)

    def _drop_from(self, k: int) -> None:
        while len(self._open) > k:
            self._at[self._open.pop().tag].pop()
        for places in (self._blocks, self._borders):
            while places and places[-1] >= k:
                places.pop()

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, and an item its elder."""
        elder = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        if not self._blocks:
            return
        name = self._open[self._blocks[-1]].tag
        if name == "p" or name in elder:
            self._drop_from(self._blocks[-1])
        if tag == "tr" and name in ("td", "th") and self._blocks and self._open[self._blocks[-1]].tag == "tr":
            self._drop_from(self._blocks[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCK or tag in DROP:
            self._flush()
        places = self._at.get(tag)
        if not places:
            return
        # An inline end tag doesn't reach out of its block, nor any out of an article.
        border = self._blocks if tag not in BLOCK else self._borders if tag not in ("body", "html", *REGION) else ()
        if not border or border[-1] <= places[-1]:
            self._drop_from(places[-1])

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1].tag in ("script", "style"):
            return
        self._parts.append(data)
        if self._at.get("a"):
            self._linked += len(data)

    def finish(self) -> list[Line]:
        if re.match(r"<[A-Za-z/!?]", self.rawdata):
            self.rawdata = ""  # a tag or comment that the page's end cut off is no text
        self.close()
        self._flush()
        return self.lines


def _believed(lines: list[Line], parents: list[int]) -> list[bool]:
    """Per doubt, if it or one around it counts: those that hold most of the text that isn't marked don't."""
    held = [0] * len(parents)
    for x in lines:
        if not x.marked:
            held[x.doubt] += len(x.text)
    most = sum(held) / 2
    for d in range(len(parents) - 1, 0, -1):  # inner doubts have larger numbers
        held[parents[d]] += held[d]
    counts = [False] * len(parents)
    for d in range(1, len(parents)):
        counts[d] = held[d] <= most or counts[parents[d]]
    return counts


def ratios(lines: list[Line], parents: list[int]) -> np.ndarray:
    """Adjusted text-to-tag ratios."""
    believed = _believed(lines, parents)
    plain = [0, 0]
    for x in lines:
        if not (x.marked or believed[x.doubt]):
            plain[x.region > 0] += len(x.text)
    articles = plain[1] > 0 and plain[1] >= ARTICLE_SHARE * sum(plain)
    out = []
    for x in lines:
        start = IN_ARTICLE if x.region else PLAIN if not x.linked else 0
        ratio = min(CAP, (start + max(0, len(x.text) - x.linked)) / max(1, x.tags))
        ratio /= STRONG if x.marked else WEAK if believed[x.doubt] else 1
        out.append(ratio / (OUTSIDE if articles and not x.region else 1))
    return np.array(out)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mass = np.convolve(np.ones(len(values)), kernel, mode="full")  # less at the page's ends
    return (np.convolve(values, kernel, mode="full") / mass)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Parts the logarithms in two clusters of least spread (the best of all cuts). Unless the upper cluster's values are
    ``APART`` times the lower's, they are one cluster and all content."""
    logs = np.sort(np.log1p(values))
    if len(logs) < 2 or logs[0] == logs[-1]:
        return -np.inf
    n = np.arange(1, len(logs))
    sums, squares = np.cumsum(logs), np.cumsum(logs**2)
    spread = squares[-1] - sums[:-1] ** 2 / n - (sums[-1] - sums[:-1]) ** 2 / (len(logs) - n)
    spread[logs[1:] == logs[:-1]] = np.inf
    cut = int(np.argmin(spread))
    if np.expm1(logs[cut + 1 :].mean()) < APART * np.expm1(logs[: cut + 1].mean()):
        return -np.inf
    return float(np.expm1((logs[cut] + logs[cut + 1]) / 2))


def main_text(html: str) -> str:
    """The lines of the content cluster, in page order, joined by one line feed."""
    parser = Lines()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    lines = parser.finish()
    if all(x.marked for x in lines):
        return ""
    own = ratios(lines, parser.parents)
    level = np.minimum(smooth(own), LIFT * own)
    bar = threshold(level)
    return "\n".join(x.text for x, v in zip(lines, level, strict=True) if v >= bar)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Columns ``keep`` of every row and the page's ``text`` and ``n_chars`` (code points); whole pages, no shuffle.

    Null html counts as empty, and a page without content has an empty text. White space, also of character references, inside
    a block becomes one space. Repeated rows and null ids pass through. An empty table gives an empty one. Other columns
    aren't read; ``keep`` may not name a column text or n_chars.
    """
    ensure_workers(pages.sparkSession)
    schema = pages.select(*keep).schema.add("text", "string", False).add("n_chars", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, text_or_empty(html_col).alias("__html")).mapInArrow(run, schema)

"""Main text of HTML pages: streamed parser events, text-to-tag ratios per line, smoothing and threshold clustering.

A page has no lines of its own, so a block of text between block-level tags is a line. Its ratio is its characters to
its tags; Gaussian smoothing spreads ratios over neighbours. What tags, roles and class words say is weak evidence only: it
lowers the smoothed ratio, as links in a line do. A threshold then parts the lines into two clusters. High lines are
content: they are kept, and with the article and main parts that hold any of them they span the region of the text. Low
lines are kept where the region's structure carries them: inside it, or as a heading, sentence or short section next to
it; not if they are doubted, mostly links, a run of labels or a copyright line.

A doubt never falls on an element that holds the article or main part, nor, on a page without one, on an element with much
of the content: half of it, or all if a whole class name says that it is something else ("sidebar", not "sidebar-page").
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.shared import slices

#: HTML's void and inline elements, those whose text is never read, elements and roles that are rarely the
#: article, class words that rarely are, words that make a class say how a page is laid out, and words of an article's own
#: header.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp".split())
RAW = set("script style noscript template head title iframe object svg button select textarea canvas audio video".split())
RARELY = set("nav footer aside form dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = set(
    "ad ads advert advertisement adverts adsense sponsored sponsor promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar "
    "side aside widget related recommended notice cookie cookies consent gdpr newsletter subscribe signup popup modal overlay alert comment comments disqus respond replies share sharing social ft hd foot copyright legal".split()
)
LAYOUT = set("no has have with without".split())
OWN = set("article post entry story content page section title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARTS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: How much of its smoothed ratio a doubted line keeps.
DOUBTED = 0.05
_SENTENCE = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
_RIGHTS = re.compile(r"^(©|\(c\)|copyright\b)|all rights reserved", re.I)
_SPLIT = re.compile(r"[^a-z]+")
SIGMA, REACH = 1.0, 3


class _Lines(HTMLParser):
    """Collects (text, tags, element, kept, characters of links): one line for each block.

    Elements are numbered as they begin, from 1; 0 is the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, out of the article, element
        self.n_open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.parent = [0]
        self.part = [0]  # the outermost article or main around an element
        self.inner = [0]  # the innermost one
        self.doubt = [0]  # against an element: 0 nothing, 1 its tag, role or a part of a class name, 2 a whole name
        self.heading = [False]  # whether an element is, or lies in, a heading
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0
        self.link: int | None = None  # open elements where a link began

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            _, out, element = self.open[-1] if self.open else ("", False, 0)
            self.lines.append((text, max(1, self.tags), element, not out, self.linked))
            self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self.link = len(self.open)
            if tag not in VOID and (doubt := self._doubted(tag, attrs)):
                self.flush()
                self._push(tag, False, doubt)
            return
        self.flush()
        if tag in VOID:
            return
        if any(t == "p" for t, _, _ in self.open[-4:]):
            self._pop("p")
        for other in CLOSED_BY.get(tag, ()):
            if self.open and self.open[-1][0] == other:
                self._pop(other)
        self._push(tag, tag in RAW, self._doubted(tag, attrs))

    def _doubted(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """What tag, role and class words say against an element; an article's own header is no other part."""
        inside = self.open and self.part[self.open[-1][2]]
        found = int(tag in RARELY or (tag == "header" and not inside))
        if not attrs or tag in ("html", "body"):
            return found
        own = dict(attrs)
        names = f"{own.get('class') or ''} {own.get('id') or ''}".lower().split()
        if tag in PARTS:
            return 2 if tag == "article" and any(w in ("comment", "comments") for n in names for w in _SPLIT.split(n)) else found
        if "hidden" in own or own.get("aria-hidden") == "true":
            return 2
        found = max(found, int((own.get("role") or "").lower() in ROLES))
        for name in names:
            words = set(_SPLIT.split(name)) - {""}
            bad = words & WORDS
            if bad and not words & LAYOUT and not (bad == {"header"} and (inside or words & OWN)):
                found = max(found, 2 if words == bad else 1)
        return found

    def _push(self, tag: str, out: bool, doubt: int) -> None:
        _, above, parent = self.open[-1] if self.open else ("", False, 0)
        element = len(self.parent)
        self.parent.append(parent)
        part = tag in PARTS and not doubt
        self.part.append(self.part[parent] or element * part)
        self.inner.append(element if part else self.inner[parent])
        self.doubt.append(doubt)
        self.heading.append(tag in HEADINGS or self.heading[parent])
        self.open.append((tag, above or out, element))
        self.n_open[tag] += 1

    def _pop(self, tag: str) -> None:
        while self.n_open[tag]:
            last = self.open.pop()[0]
            self.n_open[last] -= 1
            if last == tag:
                break
        if self.link is not None and self.link > len(self.open):
            self.link = None

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = None
        if tag in INLINE and not self.n_open[tag]:
            return
        self.flush()
        self._pop(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.link is not None:
            self.linked += len("".join(data.split()))

    def ends(self) -> list[int]:
        """The last element inside each element, or itself."""
        last = list(range(len(self.parent)))
        for element in range(len(last) - 1, 0, -1):
            above = self.parent[element]
            last[above] = max(last[above], last[element])
        return last


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Gaussian smoothing; the ends count less, not as if there were zeros beyond."""
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def clustered(values: np.ndarray) -> np.ndarray:
    """True for the upper of two clusters: the threshold settles midway between the clusters' means."""
    at = values.mean()
    for _ in range(30):
        high = values > at
        if high.all() or not high.any():
            break
        new = (values[high].mean() + values[~high].mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return values >= at


def outside(page: _Lines, lines: list[tuple[str, int, int, bool, int]], last: list[int]) -> list[bool]:
    """True for each element that is in no part of the article by the doubts about it or about one around it.

    Of several articles and main parts those in the fewest doubted elements hold
    the page's text, so that a wrapper of the article stays and a list of related articles goes.
    """
    size = np.zeros((2, len(last) + 1))
    high = clustered(smoothed(np.array([len(text) / tags for text, tags, *_ in lines])))
    for (text, _, element, *_), content in zip(lines, high, strict=True):
        size[:, element + 1] += len(text), len(text) * content
    total = size.cumsum(axis=1)
    held = lambda element, k=0: total[k, last[element] + 1] - total[k, element]
    above = [0] * len(last)
    for element in range(1, len(last)):
        above[element] = above[page.parent[element]] + (page.doubt[element] > 0)
    parts = [part for part in range(1, len(last)) if page.part[part] == part and held(part)]
    least = min((above[part] for part in parts), default=0)
    first = [part for part in parts if above[part] == least]  # in page order
    gone = [False] * len(last)
    for element in range(1, len(last)):
        out = page.doubt[element] > 0 and not ((k := bisect_left(first, element)) < len(first) and first[k] <= last[element])
        if out and (page.part[element] or not parts):
            share = held(element) / (held(page.part[element]) or 1)
            out = not held(element, 1) or share < (1 if page.doubt[element] == 2 else 0.5)
        gone[element] = gone[page.parent[element]] or out
    return gone


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by one space; empty if it has none."""
    page = _Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    lines = [x for x in page.lines if x[3]]
    if not lines:
        return ""
    last = page.ends()
    gone = outside(page, lines, last) if any(page.doubt) else [False] * len(last)
    doubted = np.array([gone[element] for _, _, element, *_ in lines])
    linked = np.array([min(1.0, n / len(text)) for text, _, _, _, n in lines])
    values = smoothed(np.array([len(text) / tags for text, tags, *_ in lines]))
    high = clustered(values * np.where(doubted, DOUBTED, 1.0) * (1 - linked))  # smoothing lifts a menu next to the text
    content = [x[2] for x, is_high in zip(lines, high, strict=True) if is_high]
    if not content:
        return ""
    parts = {page.part[x[2]] for x, out in zip(lines, doubted, strict=True) if not out} - {0}
    region = covering(page, last, content + [x[2] for x, out in zip(lines, doubted, strict=True) if page.part[x[2]] and not out])
    region = page.part[region] or region
    core, strong = covering(page, last, content), {page.inner[element] for element in content} - {0}
    inside = [core <= x[2] <= last[core] for x in lines]
    label = [not (h or page.heading[x[2]] or _SENTENCE.search(x[0])) for x, h in zip(lines, high, strict=True)]

    def carried(i: int) -> bool:
        """Whether a low line stays."""
        text, _, element, *_ = lines[i]
        if doubted[i]:
            return False
        within = region <= element <= last[region]
        if linked[i] >= 0.5:
            return within and (page.inner[element] in strong if page.inner[element] else inside[i])
        if parts or inside[i]:
            return within
        if _RIGHTS.search(text):
            return False
        beside = any(0 <= k < len(lines) and label[k] and not inside[k] for k in (i - 1, i + 1))
        return not label[i] or (" " in text and not beside)

    return " ".join(x[0] for i, x in enumerate(lines) if high[i] or carried(i))


def covering(page: _Lines, last: list[int], elements: list[int]) -> int:
    """The least element that holds all of those given."""
    box, end = min(elements), max(elements)
    while last[box] < end:
        box = page.parent[box]
    return box


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text, and n_chars (long, its code points). A null or empty page has the empty text.

    Each row is judged by its own page; ids may be null or repeat. Columns in keep named text or n_chars are replaced.
    """
    fields = [f for f in pages.schema if f.name in keep and f.name not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in slices(batch, "_html"):
                texts = [main_text(x) for x in found]
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*(f.name for f in fields), "text", "n_chars"])

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string, n_chars bigint"])
    return pages.select(*(F.col(f.name) for f in fields), F.col(html).cast("string").alias("_html")).mapInArrow(run, out)

"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events. Text is gathered in lines (what stands between two block-level
borders), each with its tags and its share of link text. A line's ratio is its unlinked text over its tags, where an
enclosing form, advert, comment list and the like counts as WEIGHT tags, and text of menus, headers and footers as link
text. Ratios are smoothed by a Gaussian within a stretch of equal weight and divided into two clusters on a logarithmic
scale; lines above the threshold are content. So a class name decides nothing by itself: a wrapper around the whole page
weighs on all its lines alike, and the clustering still finds the article among them. Short lines come back if they
stand in a container that holds content.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED = 1 << 18
SIGMA = 1.5
#: Tags that an enclosing part which is marked as something else counts for in a line's ratio.
WEIGHT = 1000.0
#: Marks beyond this many weigh no more.
DEEPEST = 4
#: Share of a page's unlinked text that a marked container must hold, beside its title, to be a wrapper of the article.
WRAPPER = 0.4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page. Those that stand within a line do not end it; a formula is text, its source is not.
UNSEEN = frozenset("head title script style noscript template select textarea option svg iframe object canvas audio video button annotation annotation-xml".split())
INLINE = frozenset("script style noscript template select textarea option svg iframe object canvas audio video button annotation annotation-xml".split())
#: Elements whose text counts as link text; a header's only outside the article.
ASIDE = frozenset("nav footer aside dialog menu".split())
CONTAINERS = frozenset("html body main article section div td th table center ul ol dl blockquote figure details header hgroup footer nav aside form dialog menu".split())
SOFT = frozenset("td th table ul ol dl blockquote figure details hgroup".split())
BLOCKS = CONTAINERS | (UNSEEN - INLINE) | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr thead tbody tfoot caption figcaption address hr summary fieldset legend".split())
#: Words of class, id and role that mark something other than the article.
MARKED = frozenset(
    """ad ads advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments
    commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer form gdpr login menu menubar
    modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended
    related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget
    widgets alert masthead topbar""".split()
)
#: Marked words that within the article may name one of its own parts.
PARTS = frozenset(("discussion",))
#: Words beside a marked one that make a class name say how a page looks or behaves, not what the part is.
STATE = frozenset("has have with without no not is show shows hide hides hidden enabled disabled enable disable open closed allow allows count layout page".split())
ARTICLE = frozenset("post article entry story content".split())
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
#: A start tag of these ends an open element of the same kind.
_SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: ... but never beyond these.
_BORDER = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ("td", "th", "li", "div", "section", "article", "blockquote", "body"), "option": ("select",)}
_HEADINGS = ("h2", "h3", "h4", "h5", "h6")
#: A stray end tag of an inner element closes none of these.
_STRONG = ("article", "main", "body", "table", "td")


def _words(value: str | None) -> list[list[str]]:
    """Lower-cased words of each name of a class, id or role."""
    return [[w.lower() for w in _PART.split(name) if w] for name in (value or "").split()]


class _Events(HTMLParser):
    """Gathers a page's lines and its tree of containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, unseen, container
        self.places: dict[str, list[int]] = defaultdict(list)  # tag -> where it is open, so that no lookup scans the stack
        self.parent = [-1]
        self.kind = ["#"]
        self.mark = [False]
        self.aside = [False]
        self.titled: list[int] = [-1]  # container of the first title outside of marked elements, or of the article
        self.blocks: list[tuple[str, int, int, int, bool, bool]] = []  # text, tags, link characters, container, lesser heading, paragraph
        self.links = self.hidden = self.tags = self.linked = 0
        self.articles = 0
        self.parts: list[str] = []

    def updatepos(self, i, j):
        return j  # positions are not needed

    def goahead(self, end):
        # where the last tag and comment of what is read end: beyond, none is looked for again and again
        self.last_tag, self.last_comment, self.ending = self.rawdata.rfind(">"), self.rawdata.rfind("-->"), end
        super().goahead(end)

    def parse_starttag(self, i):
        return super().parse_starttag(i) if i < self.last_tag else -1

    def parse_endtag(self, i):
        return super().parse_endtag(i) if i < self.last_tag else -1

    def parse_comment(self, i, report=1):
        if i < self.last_comment:
            return super().parse_comment(i, report)
        return len(self.rawdata) if self.ending else -1  # an open comment ends with the page

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.tags, self.linked, self.open[-1][2] if self.open else 0, self._last(_HEADINGS) >= 0, bool(self.places.get("p"))))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def _push(self, tag: str, unseen: bool, container: int) -> None:
        self.places[tag].append(len(self.open))
        self.open.append((tag, unseen, container))
        self.hidden += unseen
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def _pop(self) -> None:
        tag, unseen, _ = self.open.pop()
        self.places[tag].pop()
        self.hidden -= unseen
        self.links -= tag == "a"
        self.articles -= tag in ("article", "main")

    def _last(self, tags) -> int:
        """Where the innermost open element of these is, or -1."""
        return max((at[-1] for at in map(self.places.get, tags) if at), default=-1)

    def _aside(self, tag: str, here: int) -> bool:
        """Whether an element's name says that it is something other than the article."""
        return tag in ASIDE or (tag == "header" and not self.articles and self.kind[here] != "+")

    def _marked(self, tag: str, attrs) -> bool:
        """Whether an element is marked as something other than the article."""
        if tag in ("html", "body", "main"):
            return False
        if tag == "form":
            return True
        for name, value in attrs:
            if name in ("class", "id", "role") and any(not (MARKED - PARTS if self.articles else MARKED).isdisjoint(w) and STATE.isdisjoint(w) for w in _words(value)):
                return True
            if name == "aria-hidden" and value == "true":
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        block = tag in BLOCKS
        if block:
            self._flush()
            same = _SIBLINGS.get(tag)
            if same:
                border = self._last(_BORDER[tag])
                at = min((p[-1] for p in map(self.places.get, same) if p and p[-1] > border), default=-1) if tag in ("tr", "td", "th") else self._last(same)
                if at > border:
                    while len(self.open) > at:
                        self._pop()
        self.tags += not self.hidden
        if tag in VOID:
            return
        here = self.open[-1][2] if self.open else 0
        unseen = tag in UNSEEN or any(n == "hidden" for n, _ in attrs)
        aside = self._aside(tag, here)
        marked = (block or (tag == "span" and bool(attrs))) and self._marked(tag, attrs)
        if (tag in CONTAINERS or marked or aside) and not unseen:
            self.parent.append(here)
            said = not marked and tag in ("div", "section") and any(not ARTICLE.isdisjoint(w) for n, v in attrs if n in ("class", "id") for w in _words(v))
            self.kind.append("+" if said else tag)
            self.mark.append(marked)
            self.aside.append(aside or self.aside[here])
            here = len(self.parent) - 1
        if tag in ("h1", "article", "main") and not unseen and self.titled[0] < 0 and self._last(("header", "nav", "footer", "aside")) < 0:
            self.titled[0] = here
        self._push(tag, unseen, here)

    def handle_endtag(self, tag):
        at = self.places.get(tag)
        if tag == "br" or (tag == "p" and not at):
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
        self.tags += not self.hidden
        if at and (tag in CONTAINERS or at[-1] >= self._last(_STRONG)):
            stop = at[-1]
            while len(self.open) > stop:
                self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut off and made whole again."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(x, kernel)[reach : reach + len(x)]
    return full / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """Middle between the centres of two clusters of values (two-means, from the extremes)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = x >= middle
        if above.all() or not above.any():
            return middle
        new = float(x[~above].mean()), float(x[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _depths(events: _Events, unlinked: np.ndarray) -> np.ndarray:
    """Marks around each container; a marked container that wraps the article does not count."""
    n = len(events.parent)
    held = np.zeros(n)
    for block, text in zip(events.blocks, unlinked):
        held[block[3]] += text
    for c in range(n - 1, 0, -1):  # parents come before their children
        held[events.parent[c]] += held[c]
    wraps = set()
    c = events.titled[0]
    while c > 0:
        if held[c] >= WRAPPER * held[0]:
            wraps.add(c)
        c = events.parent[c]
    depth = np.zeros(n, dtype=np.int64)
    for c in range(1, n):
        depth[c] = min(DEEPEST, depth[events.parent[c]] + (events.mark[c] and c not in wraps))
    return depth


def content_lines(events: _Events, cut: float | None = None) -> np.ndarray:
    """Which of a page's lines are chosen. A `cut` given replaces the clustering's threshold."""
    length = np.array([len(b[0]) for b in events.blocks], dtype=float)
    tags = np.array([b[1] for b in events.blocks], dtype=float)
    linked = np.array([b[2] for b in events.blocks], dtype=float)
    where = np.array([b[3] for b in events.blocks])
    linked = np.where(np.array(events.aside)[where], length, linked)
    unlinked = np.maximum(length - linked, 0)
    depth = _depths(events, unlinked)[where]
    ratio = unlinked / (np.maximum(1, tags) * WEIGHT**depth)
    even = ratio.copy()
    borders = np.flatnonzero(np.diff(depth)) + 1
    for a, b in zip(np.concatenate(([0], borders)), np.append(borders, len(ratio))):
        even[a:b] = smooth(ratio[a:b])
    if not ratio.any():
        return np.zeros(len(ratio), bool)
    value = np.log(np.maximum(even / ratio.max(), 1 / WEIGHT))
    content = (value >= (threshold(value) if cut is None else cut)) & (2 * linked < length)
    level = int(np.bincount(depth[content], weights=(unlinked / WEIGHT**depth)[content], minlength=1).argmax())
    # short lines come back where their container, or the list, table or quotation they stand in, is among content
    good = np.zeros(len(events.parent), bool)
    good[where[content]] = True
    text_of, link_of = np.bincount(where, weights=length, minlength=len(good)), np.bincount(where, weights=linked, minlength=len(good))
    for c in range(1, len(good)):
        good[c] |= events.kind[c] in SOFT and not events.mark[c] and good[events.parent[c]] and (2 * link_of[c] <= text_of[c] or events.kind[c] == "ol")
    # ... and so do a sentence around a long link and the items of a numbered list, as of references
    aside = np.array(events.aside)[where]
    sentence = np.array([b[5] for b in events.blocks]) & (length - linked >= 2)
    numbered = np.array([k == "ol" for k in events.kind])[where]
    chosen = content | (good[where] & ((2 * linked < length) | (~aside & (sentence | numbered))) & (depth <= level))
    # a lesser heading that only links of its own part follow announces them
    for i in np.flatnonzero(chosen)[::-1]:
        if events.blocks[i][4] and i + 1 < len(chosen) and not chosen[i + 1] and not events.aside[where[i + 1]] and 2 * linked[i + 1] >= length[i + 1]:
            chosen[i] = False
    return chosen


def extract_text(html: str | None) -> str:
    """The article's text of one page, blocks joined by two line feeds; '' if there is none."""
    if not html:
        return ""
    events = _Events()
    for at in range(0, len(html), FEED):
        events.feed(html[at : at + FEED])
    events.finish()
    if not events.blocks:
        return ""
    return "\n\n".join([b[0] for b, keep in zip(events.blocks, content_lines(events)) if keep])


def _run(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = [extract_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars; one row per input row.

    Null and empty pages, and pages without text, give '' and 0. n_chars counts code points. Lines that are mostly link
    text are left out, but for paragraphs with words outside their links and numbered lists that stand among content.
    Nothing is capped; other columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")

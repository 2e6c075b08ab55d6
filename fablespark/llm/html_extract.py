"""Main text of web pages: parser events, text-to-tag ratio, smoothing, threshold clusters.

The standard library's parser streams a page's events into lines, one per
block element. A line's text-to-tag ratio is its characters over its tags. The
ratios are smoothed with a Gaussian kernel, region by region; lines over the threshold (a share
of the standard deviation of the smoothed ratios) form clusters, and clusters
vote for the region (nearest sectioning element) that they lie in. Votes in
article and main count MAIN_WEIGHT times: if they outweigh the others, those of
these regions that have votes are chosen, with the article or main around them;
one without a vote (a card of links) is not. If not, the innermost region around
all clusters outside is chosen, with everything in it: quotes, tables, short
sections. A region whose neighbours hold more words than link text is a part of
the element around them all, which is chosen instead (but not the whole body). Lines of
menus, notices, adverts, forms, comments and the like, told by element, role, class
or id, are no part of any region; nor are characters inside such an element when it stands within a
line, which goes on behind it. A class or id that has other words beside such a name
(``sidebar-right``) may speak of the layout: the element is furniture only if something of the
page lies outside it, lines of article or main (unless it lies in these itself) or a line of a
cluster. Its size does not count. The lines of the chosen regions
are kept whole, low ratios included, as short paragraphs belong to an article.

Cases: null html counts as empty; a page without content gives an empty text;
tags left open, closed twice or cut off at the end do not matter; very long
pages are read whole; repeated pages each come back; an empty table gives an
empty result. Other columns pass through; those named text or n_chars are
replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.llm.common import columns_but, quoted

# Elements of HTML by role, and words that name page furniture.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset("article main section body div".split())
MAIN = frozenset(("article", "main"))
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg object canvas menu dialog math audio video".split())
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "head"}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead topbar "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments disqus reply replies widget toolbar pagination pager copyright skip".split()
)
# Names of reader comments, and words that tell what an element has or lacks, not what it is.
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
MODIFIERS = frozenset("no not without with has have is hide hidden show".split())
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

SIGMA = 1.0
THRESHOLD_SHARE = 0.5
#: Votes in article and main count this many times.
MAIN_WEIGHT = 2.0


class _Lines(HTMLParser):
    """Streams events into lines: [pieces, tags, region, region is main].

    A piece is (characters, furniture, inside a link); ``furniture`` numbers the innermost element
    that a class or id names so, 0 for none. What stands in a dropped element is no piece.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, 0)]  # name, dropped, region, in main, furniture
        self.count: dict[str, int] = defaultdict(int)  # open elements by name
        self.made = 0
        self.parent: dict[int, int] = {}
        self.bodies: set[int] = set()
        self.furniture: list[tuple[int, bool, bool]] = [(0, False, False)]  # the one around it, is surely furniture, in main
        self.links = 0  # 1 in an a element, which never nest
        self.chars: dict[int, int] = defaultdict(int)
        self.linked: dict[int, int] = defaultdict(int)
        self.pieces: list[tuple[str, int, int]] = []
        self.tags = 0

    def _end_line(self) -> None:
        if any(not x.isspace() for x, _, _ in self.pieces):
            _, _, region, main, _ = self.open[-1]
            self.lines.append([self.pieces, self.tags, region, main])
        self.pieces, self.tags = [], 0

    def _cut(self, size: int) -> None:
        """Close what stands from that place on; each element is closed once."""
        while len(self.open) > size:
            self.count[self.open.pop()[0]] -= 1

    def _close(self, name: str) -> None:
        if self.count[name]:
            while self.open[-1][0] != name:
                self._cut(len(self.open) - 1)
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and (not self.open[-1][1] or tag in MAIN):  # a block in a dropped element ends no line around that
            self._end_line()
            if tag in ENDS_PARAGRAPH and self.count["p"]:
                self._close("p")
            if tag == "li" and self.open[-1][0] == "li":
                self._close("li")
            if tag in MAIN:  # no menu or advert that was left open holds the article
                while self.open[-1][1] or self.open[-1][4]:
                    self._cut(len(self.open) - 1)
        self.tags += 1
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        self.links = 1 if tag == "a" else self.links
        _, dropped, region, main, furniture = self.open[-1]
        if tag in REGIONS:
            if not main or tag in MAIN:
                self.made += 1
                self.parent[self.made] = region
                region = self.made
                if tag == "body":
                    self.bodies.add(region)
        main = main or tag in MAIN
        if not dropped:
            dropped = tag in DROPPED or tag == "header" and not main or self._off_page(tag, attrs)
            if not dropped and (name := self._furniture(tag, attrs)):
                self.furniture.append((furniture, name == "sure", main))
                furniture = len(self.furniture) - 1
        self.open.append((tag, dropped, region, main, furniture))
        self.count[tag] += 1

    @staticmethod
    def _off_page(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag not in ("body", "html", *MAIN) and any(k == "hidden" or k == "role" and (v or "").strip().lower() in DROPPED_ROLES for k, v in attrs)

    @staticmethod
    def _furniture(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
        """If a class or id names page furniture: "sure", or "likely" if it says something else too."""
        if tag in ("body", "html", *MAIN):
            return None
        found = None
        for k, v in attrs:
            for token in (v or "").split() if k in ("class", "id") else ():
                words = set(_NAME.findall(_HUMP.sub("-", token).lower()))
                if words & DROPPED_NAMES and not words & MODIFIERS:
                    found = "sure" if words <= DROPPED_NAMES or words & COMMENT_NAMES else found or "likely"
        return found

    def around(self, k: int) -> list[int]:
        """A furniture number and those around it, 0 last."""
        found = [k]
        while k:
            k = self.furniture[k][0]
            found.append(k)
        return found

    def drop_furniture(self, strong: list[bool]) -> None:
        """Make lines [text, tags, region, main] of what is no furniture, and add up the regions' text.

        ``strong`` tells which lines belong to a cluster.
        """
        main_at = {f for pieces, _, _, main in self.lines if main for x, f, _ in pieces if not x.isspace()}
        strong_at = {f for (pieces, *_), s in zip(self.lines, strong, strict=True) if s for x, f, _ in pieces if not x.isspace()}
        gone = [False] * len(self.furniture)
        for k in range(1, len(gone)):
            around, sure, in_main = self.furniture[k]
            gone[k] = gone[around] or sure or any(f in strong_at or f in main_at and not in_main for f in self.around(around))
        kept = []
        for pieces, tags, region, main in self.lines:
            text = " ".join("".join(x for x, f, _ in pieces if not gone[f]).split())
            if text:
                kept.append([text, tags, region, main])
                self.chars[region] += len(text)
                self.linked[region] += min(len(text), sum(len(x) for x, f, link in pieces if link and not gone[f]))
        self.lines = kept

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and (not self.open[-1][1] or self._closes_dropped(tag)):
            self._end_line()
        self.tags += 1
        if tag == "br":
            self.handle_data("\n")
        self.links = 0 if tag == "a" else self.links
        self._close(tag)

    def _closes_dropped(self, tag: str) -> bool:
        """If the end tag closes an element around the dropped ones, too."""
        for name, dropped, *_ in reversed(self.open):
            if name == tag:
                return not dropped
        return False

    def handle_data(self, data: str) -> None:
        _, dropped, _, _, furniture = self.open[-1]
        if not dropped:
            self.pieces.append((data, furniture, self.links))

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with a window of three sigma to either side."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel, mode="valid") if len(ratios) else ratios


def _region_ratios(lines: list[tuple[int, int, int]]) -> np.ndarray:
    """Smoothed text-to-tag ratios of (characters, tags, region), each region by itself, so that a card beside an article gains nothing from it."""
    raw = np.array([size / max(1, tags) for size, tags, _ in lines])
    where = np.array([region for *_, region in lines])
    order = np.argsort(where, kind="stable")
    ratio = np.empty(len(lines))
    for at in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if lines else ():
        ratio[at] = smoothed(raw[at])
    return ratio


_CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by an empty line."""
    if not isinstance(html, str) or not html:
        return ""
    parser = _Lines()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    ratio = _region_ratios([(sum(len(x) for x, _, _ in pieces), tags, region) for pieces, tags, region, _ in parser.lines])
    parser.drop_furniture(list(ratio >= THRESHOLD_SHARE * ratio.std()) if len(ratio) else [])
    lines = parser.lines
    if not lines:
        return ""
    ratio = _region_ratios([(len(text), tags, region) for text, tags, region, _ in lines])
    limit = THRESHOLD_SHARE * float(ratio.std())
    votes: dict[int, float] = defaultdict(float)
    texts: dict[int, float] = defaultdict(float)
    semantic: set[int] = set()
    for (text, _, region, main), r in zip(lines, ratio, strict=True):
        votes[region] += len(text) if r >= limit else 0
        texts[region] += len(text)
        if main:
            semantic.add(region)
    if not any(votes.values()):
        votes = texts
    if not votes:
        return ""
    inside = sum(votes[k] for k in semantic)
    outside = sum(votes.values()) - inside
    if MAIN_WEIGHT * inside >= outside:
        chosen = {k for k in semantic if votes[k]}
        for k in list(chosen):
            while (k := parser.parent.get(k, 0)) in semantic:
                chosen.add(k)
    else:
        chosen = _outside(parser, votes, semantic)
    return "\n\n".join(x[0] for x in lines if x[2] in chosen)


def _outside(parser: _Lines, votes: dict[int, float], semantic: set[int]) -> set[int]:
    """The regions chosen where the votes outside article and main prevail."""
    # Regions are numbered as they open, so that what is in one is a range of numbers.
    last = list(range(parser.made + 1))
    for k in range(parser.made, 0, -1):
        up = parser.parent[k]
        last[up] = max(last[up], last[k])

    def words(a: int, b: int) -> tuple[int, int]:
        own = [k for k in range(a, b) if k not in semantic]
        return sum(parser.chars[k] for k in own), sum(parser.linked[k] for k in own)

    voted = [k for k, v in votes.items() if v and k not in semantic]
    around = min(voted)
    while last[around] < max(voted):
        around = parser.parent[around]
    while (wider := parser.parent.get(around, 0)) and wider not in parser.bodies:
        (before, linked_before), (after, linked_after) = words(wider, around), words(last[around] + 1, last[wider] + 1)
        # An element with nothing but this region in it is passed by.
        if before + after and 2 * (linked_before + linked_after) >= before + after:
            break
        around = wider
    return {k for k in votes if around <= k <= last[around] and (votes[k] or k not in semantic)}


def extract_text(pages: DataFrame, keep_html: bool = False) -> DataFrame:
    """``pages`` (with html) and text, n_chars; the html itself goes unless asked for."""
    names = columns_but(pages, "text", "n_chars", *([] if keep_html else ["html"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["text string", "n_chars long"])
    return pages.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted(names))], F.col("html").alias("source")).mapInArrow(run, schema)

"""Main text of web pages from streaming parser events.

The standard library's parser is fed the whole page. Its events are cut into lines at block elements, each with
its text length, its number of tags and of linked characters, and the elements around it. The ratio of text to
tags of each line is smoothed with a Gaussian kernel; lines above the threshold (the ratios' standard deviation,
at most their mean) that are not mostly links form clusters, and clusters choose the content regions: with most of the clustered text inside
article, main or likewise named elements, those elements that hold clustered lines; else the span of the page from the
first to the last clustered line. A region without a clustered line is none, whatever its name. Lines inside the regions are kept whole, short ones
too, but for page furniture: menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles and hidden parts.

Element names and roles say so for certain. Class and id only help. Where a whole name of a class says furniture (`ad`,
`site-footer`, `cookie-notice`), the element goes unless it holds the region with most text or, on a page without regions, more
than half of the text; a form also if it holds more than half of that region. Where a word of it is merely part of a name
(`life-form`, `legal-analysis`, `share-price`), the ratios decide: the element stays if most of its text is clustered.

Edges: null, empty and text-free pages give an empty text; broken markup never raises: the parser reads on,
unclosed elements end with their parent; equal rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

#: HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source map area object embed".split())
HIDDEN = frozenset("script style noscript template head title iframe svg canvas object audio video nav footer aside button select textarea input option dialog menu fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip note".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion promotions banner banners "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail masthead footer foot footnav topbar toolbar "
    "cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription signup signin login register paywall "
    "social share shares sharing sharebar follow related recommended recommendations recirc trending popular widget widgets "
    "comment comments commentlist disqus respond replies reply pagination pager pagenav skip search searchform form legal copyright disclaimer outbrain taboola".split()
)
#: Words of names that often mean something else; they never say furniture for certain.
DOUBTFUL = frozenset("form legal share shares follow related popular trending rail foot head login search widget widgets banner notice notices register skip".split())
HEADS = frozenset(("header", "head"))
REGIONS = ("article", "main")
NAMED = frozenset("article content main post entry story articlebody maincontent postbody".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Standard deviation of the kernel, in lines, and its half width.
SIGMA, HALF = 1.5, 4


#: Kinds of furniture: by hints that ratios decide on, by hints that what it holds can refute, and for certain.
DOUBTED, HINTED, CERTAIN = 1, 2, 3


def named_furniture(value: str, inside: bool, tag: str) -> int:
    """What the names in a class or id say."""
    kind = 0
    for name in value.split():
        parts = [w.lower() for w in _PARTS.findall(name)]
        found = [w in FURNITURE for w in parts]
        if any(found):
            sure = all(found) and not set(parts) <= DOUBTFUL - {"notice"} or parts[-1] in FURNITURE - DOUBTFUL
            kind = max(kind, HINTED if sure or len(parts) == 1 else DOUBTED)
        elif not inside and tag == "div" and HEADS & set(parts):
            kind = max(kind, HINTED)
    return kind


def furniture(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """Whether an element is page furniture, 0 if not; inside: within an article, whose own header is not."""
    if tag in HIDDEN or tag == "header" and not inside:
        return CERTAIN
    kind = HINTED if tag == "form" else 0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return CERTAIN
        if not value or tag in ("html", "body", "main"):
            continue
        if name == "role" and value.strip().lower() in ROLES:
            if tag != "form":
                return CERTAIN
        if name in ("class", "id"):
            kind = max(kind, named_furniture(value, inside, tag))
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return CERTAIN
    return kind


class Lines(HTMLParser):
    """Lines of a page: (parts, tags, number of the region, 0 for none); parts: (characters, linked, hinted elements around, innermost region)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list, int, int]] = []
        self.parts: list[tuple[str, bool, tuple[int, ...], int]] = []
        self.tags = self.skip = self.links = 0
        self.stack: list[tuple[str, bool, int, int, tuple[int, ...]]] = []
        self.region = self.regions = self.inner = 0
        self.hints: tuple[int, ...] = ()
        #: Hinted elements, whether each is a form or doubted; by innermost region the hinted elements around it.
        self.forms: list[bool] = []
        self.doubted: list[bool] = []
        self.around: dict[int, tuple[int, ...]] = {0: ()}

    def end_line(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags, self.region))
            self.parts = []
        self.tags = 0

    def pop(self, at: int) -> None:
        for tag, hides, region, inner, hints in reversed(self.stack[at:]):
            self.skip -= hides
            self.links -= tag == "a"
            self.region, self.inner, self.hints = region, inner, hints
        del self.stack[at:]

    def shown(self) -> list[tuple[str, int, int, int]]:
        """Lines (text, tags, linked characters, region) without what hinted elements hide."""
        held, own = Counter(), Counter()  # text by innermost region, by hinted element and region
        for parts, _, _ in self.lines:
            for data, _, hints, inner in parts:
                n = sum(map(len, data.split()))
                held[inner] += n
                own.update({(hints[: i + 1], inner): n for i in range(len(hints))})
        regions = [r for r in held if r and held[r]]
        top = max(regions, key=lambda r: held[r]) if regions else 0
        opened = set(self.around[top])
        for hints, inner in own:
            if inner == top and 2 * own[hints, inner] > held[top] and (not top or self.forms[hints[-1]]):
                opened.update(hints)
        opened.update(self.cleared())
        out = []
        for parts, tags, region in self.lines:
            seen = [(data, linked) for data, linked, hints, _ in parts if opened.issuperset(hints)]
            text = " ".join("".join(data for data, _ in seen).split())
            if text:
                out.append((text, tags, sum(len(data) for data, linked in seen if linked), region))
        return out

    def cleared(self) -> set[int]:
        """Doubted elements most of whose text lies in clustered lines, all lines counted."""
        if not any(self.doubted):
            return set()
        texts = [" ".join("".join(data for data, *_ in parts).split()) for parts, _, _ in self.lines]
        linked = [sum(len(data) for data, link, *_ in parts if link) for parts, _, _ in self.lines]
        lines = [(t, n, k) for t, (_, n, _), k in zip(texts, self.lines, linked, strict=True)]
        ratio = np.array([len(t) / max(1, n) for t, n, _ in lines], float)
        good = clustered(lines) & (ratio >= min(ratio.std(), ratio.mean()))  # what the neighbours lend does not count here
        held, own = Counter(), Counter()
        for (parts, _, _), ok in zip(self.lines, good, strict=True):
            for data, _, hints, _ in parts:
                for h in hints:
                    if self.doubted[h]:
                        n = sum(map(len, data.split()))
                        held[h] += n
                        own[h] += n * bool(ok)
        return {h for h in held if 2 * own[h] > held[h]}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.end_line()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # ends an open one of its kind
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == tag:
                        self.pop(i)
                        break
                    if self.stack[i][0] not in INLINE and self.stack[i][0] != "p":
                        break
        elif tag == "br":
            self.parts.append((" ", False, self.hints, self.inner))
        self.tags += 1
        if tag in VOID:
            return
        kind = furniture(tag, attrs, self.region > 0) if attrs or tag in HIDDEN or tag in ("header", "form") else 0
        hides = kind == CERTAIN
        self.stack.append((tag, hides, self.region, self.inner, self.hints))
        self.skip += hides
        self.links += tag == "a"
        if kind in (HINTED, DOUBTED) and not self.skip:
            self.hints += (len(self.forms),)
            self.forms.append(tag == "form")
            self.doubted.append(kind == DOUBTED)
        if not self.skip and (tag in REGIONS or attrs and tag in ("div", "section", "td") and self.named(attrs)):
            self.regions += 1
            self.inner = self.regions
            self.region = self.region or self.inner
            self.around[self.inner] = self.hints

    @staticmethod
    def named(attrs: list) -> bool:
        return any(n in ("class", "id") and v and NAMED & set(re.sub(r"[-_]", "", v.lower()).split()) or n == "role" and v in REGIONS for n, v in attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                break
            if tag in INLINE and self.stack[i][0] not in INLINE:
                break

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown section is a comment up to the next >
            return self.rawdata.find(">", i + 3) + 1 or -1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append((data, self.links > 0, self.hints, self.inner))


def smoothed(ratios: np.ndarray) -> np.ndarray:
    x = np.arange(-HALF, HALF + 1)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[HALF : HALF + len(ratios)]
    return np.convolve(ratios, kernel, "full")[HALF : HALF + len(ratios)] / weight


def clustered(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """Which lines (text, tags, linked characters) are content: their smoothed ratio is above the threshold and they are not mostly links."""
    ratio = smoothed(np.array([len(t) / max(1, n) for t, n, _ in lines], float))
    return (ratio >= min(ratio.std(), ratio.mean())) & np.array([bool(t) and 2 * k <= len(t) for t, _, k in lines])


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    lines = page.shown()
    if not lines:
        return ""
    good = np.flatnonzero(clustered([line[:3] for line in lines])).tolist()
    if not good:
        return ""
    inside = sum(len(lines[i][0]) for i in good if lines[i][3])
    if 2 * inside >= sum(len(lines[i][0]) for i in good):
        held = {lines[i][3] for i in good} - {0}
        kept = [t for t, _, _, r in lines if r in held]
    else:
        kept = [t for i, (t, _, linked, _) in enumerate(lines) if good[0] <= i <= good[-1] and 2 * linked <= len(t)]
    return "\n\n".join(kept)


def _extracted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = [main_text(h) for h in batch.column("html").to_pylist()]
    yield pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def extract(pages: DataFrame) -> DataFrame:
    """Per page page_id, url, text and n_chars."""
    return mapped(pages.select("page_id", "url", "html"), _extracted, "page_id long, url string, text string, n_chars long")

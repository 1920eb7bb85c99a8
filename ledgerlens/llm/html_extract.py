"""Main text of web pages by text-to-tag ratios.

The events of the standard library's parser are gathered into lines, one per block of text, each with the number of
tags it took.  The ratio of text to tags is smoothed over neighbouring lines with a Gaussian, and lines above a share of
the standard deviation are content.  A content line stands for the region it lies in (an article, else the nearest
container): all lines of the region are kept, short ones too, but for elements that never are main text.  Regions with
content are joined under the container they share, or the article or main element around them: what lies between them
stays, and what lies beside them in that container up to the next line of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import slices

# Names of elements, roles, and words of class or id attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
HIDDEN = set(
    "script style noscript template head title svg math iframe object canvas audio video select option button form "
    "textarea input nav footer aside menu dialog fieldset".split()
)
REGIONS = set("article main section div td body center".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
CLUTTER = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer form hidden menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
NEGATIONS = set("no not non without with has hide".split())
HOLDERS = set("article body container content entry inner layout main page post story text wrap wrapper".split())
LIST_OWNERS = set("ul ol dl table body article main section div".split())

_UNFINISHED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_NAMES = re.compile(r"[a-z0-9]+")

#: Share of a line's characters in links from which on it is a line of links.
LINKS = 0.5

#: Width of the smoothing in lines, and the share of the standard deviation a content line must reach.
SIGMA, SHARE = 1.0, 0.5


class Lines(HTMLParser):
    """Gathers (text, tags, region, characters in links) for every block of text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        #: Open elements: name, whether its text is hidden, its region, whether inside an article, whether in a link.
        self.open: list[tuple[str, bool, int, bool, bool]] = []
        #: Name and surrounding region of each region; the first is the page itself.
        self.regions: list[tuple[str, int]] = [("", 0)]
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            region = self.open[-1][2] if self.open else 0
            self.lines.append((text, self.tags, region, self.linked))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def close_to(self, depth: int) -> None:
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in ENDS_PARAGRAPH:
            self.end_within({"p"}, REGIONS)
        if tag in CLOSED_BY_SIBLING:
            self.end_within(CLOSED_BY_SIBLING[tag], LIST_OWNERS)
        if tag in VOID:
            return
        _, hidden, region, inside, linked = self.open[-1] if self.open else ("", False, 0, False, False)
        if not hidden:
            hidden = tag in HIDDEN or (tag == "header" and not inside) or (tag not in ("html", "body", "article", "main") and clutter(attrs))
        if tag in REGIONS and not inside:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.open.append((tag, hidden, region, inside or tag == "article", linked or tag == "a"))

    def end_within(self, names: set[str], stop: set[str]) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]
            if name in names:
                self.close_to(depth)
                return
            if name in stop:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.close_to(depth)
                return
            if tag in INLINE and self.open[depth][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)
            if self.open and self.open[-1][4]:
                self.linked += len(data.strip())


def clutter(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the attributes of an element say that it is hidden or no part of the text."""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value and value.lower() in ROLES:
            return True
        if name in ("class", "id") and value and any(map(names_clutter, value.lower().split())):
            return True
        if name == "style" and value and "display:none" in value.lower().replace(" ", ""):
            return True
    return False


def names_clutter(name: str) -> bool:
    """Whether a class or id names clutter itself, not an element with, without or for content beside it."""
    parts = _NAMES.findall(name)
    found = next((i for i, part in enumerate(parts) if part in CLUTTER), None)
    return found is not None and NEGATIONS.isdisjoint(parts[:found]) and (parts[-1] in CLUTTER or parts[-1] not in HOLDERS)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel, "same") if len(ratios) >= len(kernel) else None
    if weights is not None:
        return np.convolve(ratios, kernel, "same") / weights
    at = np.arange(len(ratios))
    near = np.exp(-0.5 * ((at[:, None] - at) / sigma) ** 2) * (np.abs(at[:, None] - at) <= reach)
    return near @ ratios / near.sum(axis=1)


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The main text of one page, blocks joined by a line feed; empty if there is none."""
    parser = Lines()
    parser.feed(_UNFINISHED.sub("", html or ""))
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _, _ in lines])
    smooth = smoothed(ratios, sigma)
    # A line must hold text itself: smoothing alone also lifts the links next to an article.
    least = min(share * smooth.std(), smooth.max())
    content = (smooth >= least) & (ratios >= min(least, ratios.max()))
    if not content.any():
        content = ratios == ratios.max()
    kept = joined(parser, content)
    return "\n".join(line[0] for line, stays in zip(lines, kept) if stays)


def joined(parser: Lines, content: np.ndarray) -> np.ndarray:
    """The lines of the regions with content, and those between or beside such regions in a container they share."""
    many = len(content)
    of_line = np.array([region for _, _, region, _ in parser.lines])
    links = np.array([linked >= LINKS * len(text) for text, _, _, linked in parser.lines])
    regions = len(parser.regions)
    own = np.bincount(of_line[content], minlength=regions) > 0
    # Per region with all regions in it: its first and last line, the first and last with content, and in how many
    # places right below it there is content.  A region stands after the one it lies in.
    at = np.arange(many)
    low, high, first, last = np.full(regions, many), np.full(regions, -1), np.full(regions, many), np.full(regions, -1)
    np.minimum.at(low, of_line, at)
    np.maximum.at(high, of_line, at)
    np.minimum.at(first, of_line[content], at[content])
    np.maximum.at(last, of_line[content], at[content])
    places = own.astype(int)
    for region in range(regions - 1, 0, -1):
        around = parser.regions[region][1]
        low[around], high[around] = min(low[around], low[region]), max(high[around], high[region])
        if places[region]:
            places[around] += 1
            first[around], last[around] = min(first[around], first[region]), max(last[around], last[region])
    # The nearest lines of links before and after each line.
    before = np.maximum.accumulate(np.where(links, at, -1))
    after = np.minimum.accumulate(np.where(links, at, many)[::-1])[::-1]
    change = np.zeros(many + 1, int)
    for region, (name, _) in enumerate(parser.regions):
        if places[region] >= (1 if name in ("article", "main") else 2):
            start, end = first[region], last[region]
            if name not in ("", "body"):
                start = max(low[region], min(start, before[start] + 1))
                end = min(high[region], max(end, after[end] - 1))
            change[start] += 1
            change[end + 1] -= 1
    return own[of_line] | ((np.cumsum(change)[:-1] > 0) & ~links)


def extract(pages: DataFrame, sigma: float = SIGMA, share: float = SHARE) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    A null or empty html, and a page without text, gives an empty text.  An unfinished tag at the end of the html is
    no text.  Repeated rows give repeated rows, null ids and urls are kept.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(html, sigma, share) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

"""Main text of web pages from a stream of parser events.

The standard library's parser gives events; blocks of text end at block-level
tags and are the page's lines. Each has a text-to-tag ratio: its characters for
each tag in and around it. Their logarithms, so that one long block doesn't outshine
its neighbours, are smoothed with a Gaussian over lines and split in two clusters. The content region is the
container whose lines of the upper cluster outweigh those of the lower one most; an
article or main part weighs somewhat more. All its lines are kept but for parts
inside it that are link lists of the lower cluster.

What HTML itself marks as no content (scripts, navigation, footers, forms, hidden
parts ...) is never a line of a region. A class or id that names boilerplate is a
weaker sign: it counts for a part that holds less than half of the page's text, or
beside an article that holds a quarter of it.

Cases: null or empty html, or none but boilerplate: empty text; null keys and
repeated rows are returned each; empty table: no rows; other columns are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm.common import bounded_batches

# HTML's element names by their part in a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu search header".split())
PREFERRED = frozenset(("article", "main"))
DROPPED_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article aside blockquote body center dd details div dl fieldset figure hgroup html li main ol section table tbody td tr ul".split())
NAMES = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent notice popup modal overlay comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe signup login search widget pagination pager skip copyright legal toolbar hidden".split())
PLACES = frozenset("site page global top bottom left right blog".split())
SPACE = re.compile(r"\s+")
SIGMA, LIKE, LINE_COST, PREFERENCE = 1.0, 2.0, 40, 0.15
PART = re.compile(r"[-_]+")


def names_boilerplate(value: str) -> bool:
    """Whether a class or id names boilerplate: by a whole word, its first part, or its last part after a place's name."""
    for word in value.lower().split():
        parts = PART.split(word)
        if word in NAMES or parts[0] in NAMES or parts[0] in PLACES and parts[-1] in NAMES:
            return True
    return False


class Lines(HTMLParser):
    """Blocks of a page, each with its text, tags, characters in links, container, and whether it is dropped or a heading.

    Containers are numbered; `parent`, `preferred` and `named` tell of each.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.drop = self.heading = 0
        self.open: list[tuple[str, bool, int]] = []  # blocks: tag, whether dropped, container before it
        self.count: dict[str, int] = {}
        self.at = 0
        self.parent, self.preferred, self.named = [0], [False], [False]

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts.clear()
            if text:
                self.lines.append((text, self.tags, self.linked, self.at, self.drop > 0, self.heading > 0))
                self.tags = 0
            self.linked = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCK or tag in DROPPED:
            self.end_block()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        dropped = tag in DROPPED and not (tag == "header" and self.inside_preferred())
        named = False
        for name, value in attrs if tag not in ("html", "body") else ():
            if name == "hidden" or name == "aria-hidden" and value == "true" or value and (name == "role" and value.lower() in DROPPED_ROLE or name == "style" and "display:none" in value.replace(" ", "").lower()):
                dropped = dropped or tag in BLOCK or tag == "span"
            elif value and name in ("class", "id") and tag in BLOCK and tag not in PREFERRED:
                named = named or names_boilerplate(value)
        if tag == "p":  # it ends an open paragraph
            self.shut("p", within=BLOCK)
        if tag in BLOCK or dropped:
            self.end_block()
            self.open.append((tag, dropped, self.at))
            self.count[tag] = self.count.get(tag, 0) + 1
            self.drop += dropped
            self.heading += tag in HEADING
            if tag in CONTAINER or named:
                self.parent.append(self.at)
                self.preferred.append(tag in PREFERRED)
                self.named.append(named)
                self.at = len(self.parent) - 1

    def inside_preferred(self) -> bool:
        return any(self.count.get(t, 0) for t in PREFERRED)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID or tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def shut(self, tag: str, within=frozenset()) -> None:
        if not self.count.get(tag, 0):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, dropped, _ in self.open[i:]:
                    self.count[name] -= 1
                    self.drop -= dropped
                    self.heading -= name in HEADING
                self.at = self.open[i][2]
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCK or tag in DROPPED or self.count.get(tag, 0):
            self.end_block()
            self.shut(tag)
        self.tags += 1

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return total / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def split_value(values: np.ndarray) -> float:
    """The value between two clusters of one dimension (2-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        up = values > middle
        if not up.any() or up.all():
            break
        new = float(values[~up].mean()), float(values[up].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def upper_lines(ratio: np.ndarray) -> np.ndarray:
    """Lines of the upper of two clusters of smoothed ratios; all, if the clusters are alike."""
    value = smoothed(np.log1p(ratio))
    up = value >= split_value(value)
    if up.all() or np.expm1(value[up].mean()) < LIKE * max(np.expm1(value[~up].mean()), 1e-9):
        return np.ones(len(ratio), bool)
    return up


def _below(own: np.ndarray, parent: list[int]) -> np.ndarray:
    """Sums over containers and all within them; a container's number is above its parent's."""
    total = own.astype(np.float64)
    for k in range(len(parent) - 1, 0, -1):
        total[parent[k]] += total[k]
    return total


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_block()
    lines = page.lines
    if not lines:
        return ""
    n, parent = len(page.parent), page.parent
    size = np.array([len(x[0]) for x in lines])
    at = np.array([x[3] for x in lines])
    kept = ~np.array([x[4] for x in lines])
    up = upper_lines(np.array([len(t) / max(1, tags) for t, tags, *_ in lines]))
    text = _below(np.bincount(at, size * kept, n), parent)
    article = np.array(page.preferred)
    for k in range(1, n):
        article[k] |= article[parent[k]]
    best = _below(np.bincount(at, size * kept * article[at], n), parent)
    # a part named boilerplate goes if it is the lesser part of the page, or an article stands beside it
    out = np.zeros(n, bool)
    for k in range(1, n):
        beside = best[0] - best[k] >= text[0] / 4
        out[k] = out[parent[k]] or page.named[k] and (text[k] < text[0] / 2 or beside)
    kept &= ~out[at]
    if not kept.any():
        return ""
    heading = np.array([x[5] for x in lines])
    worth = np.where(up, size, np.where(heading, -5, -(size + LINE_COST))) * kept
    total = _below(np.bincount(at, worth, n), parent)
    total += np.array(page.preferred) * PREFERENCE * np.abs(total)
    usable = np.flatnonzero(_below(np.bincount(at, size * kept, n), parent) > 0)
    root = int(usable[np.argmax(total[usable])])
    inside = np.zeros(n, bool)
    inside[root] = True
    for k in range(root + 1, n):
        inside[k] = inside[parent[k]]
    # parts within it that hold nothing but links of the lower cluster
    linked = np.array([x[2] for x in lines])
    loose = _below(np.bincount(at, kept * (up | (linked < 0.5 * size)), n), parent) == 0
    menu = np.zeros(n, bool)
    for k in range(root + 1, n):
        menu[k] = inside[k] and (menu[parent[k]] or loose[k])
    return "\n\n".join(x[0] for x, good in zip(lines, kept & inside[at] & ~menu[at], strict=True) if good)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    few = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return few.mapInArrow(run, "page_id long, url string, text string, n_chars long")

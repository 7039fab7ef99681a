"""Main-text extraction from HTML: parser events, text-to-tag ratios, smoothing, clusters.

``html.parser`` events cut a page into lines (one per block element). Each line has its text,
its tag count and its place in the element tree. The ratio of text length to tags per line
is smoothed with a Gaussian over neighbouring lines, and a two-means split of the smoothed
ratios marks the lines of running text. They select the content region: the ``article`` or
``main`` elements that hold such lines, else the smallest element around all of them. Every
line of the region counts, short ones too, less the parts that are boilerplate by element
(menus, footers, asides, forms, scripts, styles...) or by the words of their class, id or
role (ad, sidebar, cookie, comments...).

White space inside a line becomes one space, lines are trimmed, empty ones dropped, and the
rest joined in page order by one newline.

Defined cases: NULL or empty html, and pages without running text, give ``""`` with 0
characters; broken markup never raises (unknown ends are ignored, open elements end with the
page); text outside any element belongs to the page; repeated rows give repeated results;
extra columns are not read. A page is parsed whole, in one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element classes and boilerplate words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset(
    "script style noscript template head title nav footer aside form iframe object svg canvas "
    "button select option textarea input menu dialog audio video map".split())
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu "
    "nav navbar navigation breadcrumb breadcrumbs toolbar footer masthead comment comments "
    "disqus respond reply replies share sharing social related recommended newsletter "
    "subscribe subscription signup login search pagination pager widget copyright "
    "complementary contentinfo".split())
ROOTS = frozenset(("article", "main"))
NEVER = frozenset(("html", "body", "article", "main"))
ENDED_BY_BLOCK = frozenset(("p",))
ENDS_SAME = frozenset("li dt dd tr td th option".split())
_WORDS = re.compile(r"[a-z0-9]+")
SIGMA = 1.0
LINK_SHARE = 0.5
SCHEMA = "page_id long, url string, text string, n_chars long"


class _Line:
    __slots__ = ("parts", "tags", "links", "path", "skip")

    def __init__(self, path: tuple[int, ...], skip: bool) -> None:
        self.parts, self.tags, self.links, self.path, self.skip = [], 1, 0, path, skip

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Events(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []
        self.count = self.link = 0
        self.roots: set[int] = set()
        self.lines: list[_Line] = []
        self.fresh = True

    def _boilerplate(self, tag: str, attrs: list) -> bool:
        if tag in SKIP:
            return True
        if tag in NEVER:
            return False
        if tag == "header":
            return not any(i in self.roots for _, i, _ in self.open)
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                if not BOILERPLATE.isdisjoint(_WORDS.findall(value.lower())):
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def _end(self, at: int) -> None:
        for tag, _, _ in self.open[at:]:
            if tag == "a":
                self.link = max(0, self.link - 1)
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag not in INLINE:
                self.fresh = True
            elif tag == "br":
                self._text(" ")
            if self.lines:
                self.lines[-1].tags += 1
            return
        if tag not in INLINE:
            self.fresh = True
            if self.open and (self.open[-1][0] in ENDED_BY_BLOCK or any(
                    t == "p" for t, _, _ in self.open[-4:])):
                at = max(i for i, (t, _, _) in enumerate(self.open) if t == "p") if any(
                    t == "p" for t, _, _ in self.open) else None
                if at is not None and all(t in INLINE for t, _, _ in self.open[at + 1:]):
                    self._end(at)
            if tag in ENDS_SAME and self.open and self.open[-1][0] == tag:
                self._end(len(self.open) - 1)
        self.count += 1
        skip = bool(self.open) and self.open[-1][2]
        if tag in ROOTS:
            self.roots.add(self.count)
        self.open.append((tag, self.count, skip or self._boilerplate(tag, attrs)))
        if tag == "a":
            self.link += 1
        if self.lines and not self.fresh:
            self.lines[-1].tags += 1

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if tag not in INLINE:
            self.fresh = True
        elif self.lines and not self.fresh:
            self.lines[-1].tags += 1
        if at is not None and (tag not in INLINE or all(
                t in INLINE for t, _, _ in self.open[at:])):
            self._end(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self._text(data)

    def _text(self, data: str) -> None:
        skip = bool(self.open) and self.open[-1][2]
        if self.fresh or not self.lines or self.lines[-1].skip != skip:
            path = tuple(i for t, i, _ in self.open if t not in INLINE)
            self.lines.append(_Line(path, skip))
            self.fresh = False
        line = self.lines[-1]
        line.parts.append(data)
        if self.link:
            line.links += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring lines (window of three sigma)."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = weights[abs(i - j)]
            total += w * values[j]
            norm += w
        out.append(total / norm)
    return out


def split_point(values: list[float]) -> float:
    """Threshold between the two clusters of one-dimensional two-means."""
    low, high = min(values), max(values)
    if low == high:
        return low
    for _ in range(20):
        cut = (low + high) / 2
        under = [v for v in values if v < cut]
        over = [v for v in values if v >= cut]
        new = (sum(under) / len(under) if under else low, sum(over) / len(over) if over else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    events.close()
    lines = [(line, text) for line in events.lines if (text := line.text)]
    if not lines:
        return ""
    ratio = smooth([0.0 if line.skip else len(text) / line.tags for line, text in lines])
    cut = split_point(ratio)
    usable = [(line, text, r) for (line, text), r in zip(lines, ratio) if not line.skip]
    in_root = [x for x in usable if not events.roots.isdisjoint(x[0].path)]
    running = [x for x in usable if x[2] >= cut] or usable
    if not running:
        return ""
    if in_root:
        held = [x for x in running if not events.roots.isdisjoint(x[0].path)] or in_root
        top = {next(i for i in line.path if i in events.roots) for line, _, _ in held}
        return "\n".join(t for line, t, _ in usable if not top.isdisjoint(line.path))
    prose = [x for x in running if x[0].links <= LINK_SHARE * len(x[1])] or running
    region = prose[0][0].path[:-1] or prose[0][0].path
    for line, _, _ in prose:
        n = 0
        while n < min(len(region), len(line.path)) and region[n] == line.path[n]:
            n += 1
        region = region[:n]
    return "\n".join(t for line, t, _ in usable if line.path[:len(region)] == region
                     and line.links <= LINK_SHARE * len(t))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url",
                            "cast(html as string) html").mapInArrow(run, SCHEMA)

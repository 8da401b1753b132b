"""Main text of web pages, by text-to-tag ratios."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm._shared import text_batches

#: Elements whose content is never main text.
DROPPED = frozenset("script style noscript template head title nav header footer aside button select option textarea input label iframe object embed svg canvas dialog menu audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of a class, id or role that name what is beside the main text.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies respond share sharing sidebar side-bar skip social sponsor sponsored subscribe toolbar widget".split())
#: What the ratios of lines in an article or main element count times, where that element holds all of the page's text.
BOOST = 16
#: Characters from which a line that is all link counts as prose.
LONG_LINK = 80
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Elements that end at the start of another of their kind or, of those listed, of a block.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Lines(HTMLParser):
    """Streams parser events into lines, one per block: (text, tags met, in an article, share of its characters that are
    links, in a form)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, float, bool]] = []
        self.forms = 0
        self.stack: list[tuple[str, bool]] = []  # open elements, and whether each is dropped
        self.dropped = 0
        self.articles = 0
        self.links = 0
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0  # characters of the line's links

    def end_line(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text or self.tags:
            self.lines.append((text, self.tags, self.articles > 0, min(1.0, self.linked / max(len(text), 1)), self.forms > 0))
        self.text, self.tags, self.linked = [], 0, 0

    def pop(self):
        tag, drops = self.stack.pop()
        self.dropped -= drops
        self.articles -= tag in ("article", "main")
        self.links -= tag == "a"
        self.forms -= tag == "form"

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        if not self.dropped:
            self.tags += 1
        if tag in VOID:
            return
        closes = _CLOSES.get(tag)
        if tag in BLOCKS:
            # A paragraph ends where a block starts, and with it what it left open.
            for k in range(len(self.stack) - 1, -1, -1):
                at = self.stack[k][0]
                if at == "p" or closes and at in closes:
                    while len(self.stack) > k:
                        self.pop()
                    break
                if at in BLOCKS:
                    break
        drops = tag in DROPPED or self.beside(attrs)
        if tag == "header" and self.articles and not drops:
            drops = True
        self.stack.append((tag, drops))
        self.dropped += drops
        self.articles += tag in ("article", "main")
        self.links += tag == "a"
        self.forms += tag == "form"

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")

    @staticmethod
    def beside(attrs) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                if any(w.lower() in ASIDE_WORDS for w in _WORDS.findall(value)):
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        if tag == "br":
            self.text.append(" ")
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                break
            # A stray end tag doesn't close what encloses it.
            if self.stack[k][0] in BLOCKS and tag not in BLOCKS:
                break
        if not self.dropped:
            self.tags += 1

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(_SPACE.sub(" ", data).strip())


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over three sigma to each side, edges by what is there."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    n, out = len(values), []
    for i in range(n):
        total = norm = 0.0
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            w = weights[abs(i - j)]
            total += w * values[j]
            norm += w
        out.append(total / norm)
    return out


def regions(lines: list[tuple[str, int, bool, float, bool]], sigma: float = 1.0) -> list[str]:
    """The lines of content regions.

    Lines in forms go first, unless they are most of the page, as where one form wraps it. A line's ratio is its
    characters over its tags (one at least); those of links count only in lines of LONG_LINK characters or more, so a page
    of nothing but short links has no content. Ratios are smoothed; lines at or above the threshold,
    the standard deviation of the smoothed ratios but no more than half their mean, are content. They cluster in
    regions: a stretch without two lines in a row below. Article and main elements are a prior only: a line in one is
    held against the threshold with its smoothed ratio times BOOST to the power of the share that these elements have
    in the page's characters and of the share of the line that is no link. So short lines of a marked body stay, link
    lists in it must pass by their ratio alone, and an element that only wraps a teaser says next to nothing.
    """
    lines = [x for x in lines if x[0]]
    if 2 * sum(len(x[0]) for x in lines if x[4]) <= sum(len(x[0]) for x in lines):
        lines = [x for x in lines if not x[4]]
    said = [len(text) * (1 - linked if len(text) < LONG_LINK else 1) for text, _, _, linked, _ in lines]
    if not any(said):
        return []
    ratio = smoothed([n / max(x[1], 1) for n, x in zip(said, lines)], sigma)
    mean = sum(ratio) / len(ratio)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    threshold = min(deviation, mean / 2)
    share = sum(len(x[0]) for x in lines if x[2]) / sum(len(x[0]) for x in lines)
    content = [r * (BOOST ** (share * (1 - linked)) if marked else 1) >= threshold for r, (_, _, marked, linked, _) in zip(ratio, lines)]
    for i in range(1, len(content) - 1):
        if content[i - 1] and content[i + 1]:
            content[i] = True
    return [x[0] for x, c in zip(lines, content) if c]


def main_text(html: str | None) -> str:
    """Main text of one page: blocks in order, joined by line feeds, white space collapsed in each."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n".join(regions(parser.lines))


def _texts(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` and text, the main text of the whole page, of every row; null and empty pages have none. Repeated
    rows each get theirs; unclosed elements end where what encloses them does, or the page. Other columns don't matter."""
    text_batches(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(html, *keep).mapInArrow(_texts, f"{schema}, text string")

"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, in page order. Blocks that only their class or id names as frame stay if they
hold an ``article``, ``main`` or ``h1``, or nearly all text; then what stands in them decides. A line counts the characters outside links; blocks that
belong to the frame of a page (menus, headers, footers, sidebars, notices, adverts, forms, comments) count as
EMPTY_LINES empty lines. Where a page has an ``article`` or ``main`` with text, all lines in it that belong to no frame block are kept.
On other pages text lengths are summed over sliding windows of WINDOW lines. The text surges where a window holds SURGE characters after an empty one and
dives where the windows are empty again; what lies between a surge and its dive is a section. The section with most
text is kept whole, and others that hold at least OTHER_SHARE of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
EMPTY_LINES = 3
SURGE = 40
OTHER_SHARE = 0.2
HARD, NAMED = 1, 2

# fixed values: HTML element names
_RAW = frozenset("script style noscript template textarea title iframe svg canvas object audio video math select xmp noembed".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FRAME = frozenset("nav footer aside form head menu button dialog fieldset search".split())
_HEADINGS_AND_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
# head words of class and id names that mark a block of the page's frame
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments "
    "disqus reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login search toolbar widget widgets pagination pager copyright disclaimer".split()
)
_OWN_HEADER = frozenset("article entry post content story".split())
# words that say nothing about what a block holds: the name before them is its head
_PLAIN = frozenset(
    "area bar block body box button buttons container content form group holder icons inner item items left link links list outer panel "
    "posts right row section slot top bottom unit wrap wrapper".split()
)
# words that deny or mention the name after them
_ABOUT = frozenset("has with without no not hide hides is of for".split())
_TITLED = frozenset("article main h1".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _head(name: str) -> str:
    """The word of a class or id name that says what the block is; empty if another word denies or only mentions it."""
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    if not _ABOUT.isdisjoint(parts):
        return ""
    while len(parts) > 1 and (parts[-1] in _PLAIN or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] if parts else ""


def _framed(tag: str, attributes: str, inside: bool) -> int:
    """HARD or NAMED (by class or id only) if an element belongs to the frame of the page, else 0. ``inside``: it stands in an article."""
    if tag in _FRAME or tag == "header" and not inside:
        return HARD
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    heads: set[str] = set()
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            heads.update(_head(name) for name in value.split())
            names.update(p.lower() for p in _NAME_PART.findall(value))
        elif key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return HARD
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
    return NAMED if heads & _NAMES or "header" in heads and not inside and not names & _OWN_HEADER else 0


class _Lines:
    """Lines of a page as (text, characters outside links, stands in an article or main, named blocks around it)."""

    def __init__(self):
        self.lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.linked = 0
        #: open block elements: name, whether they are HARD or NAMED
        self.open: list[tuple[str, int]] = []
        #: open named blocks, number of all, and the named blocks around each article, main and h1
        self.named: tuple[int, ...] = ()
        self.blocks = 0
        self.titles: list[tuple[int, ...]] = []
        self.framed = self.articles = self.links = 0

    def text(self, raw: str) -> None:
        if raw and not self.framed:
            self.parts.append(raw)
            if self.links:
                self.linked += len("".join(html.unescape(raw).split()))

    def flush(self) -> None:
        if self.parts:
            line = " ".join(html.unescape("".join(self.parts)).split())
            if line:
                visible = len(line.replace(" ", ""))
                own = visible - self.linked
                self.lines.append((line, len(line) if 2 * own > visible else 0, self.articles > 0, self.named))
        self.parts, self.linked = [], 0

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links += 1
        if tag not in _BLOCKS:
            if tag == "br":
                self.text(" ")
            return
        self.flush()
        while self.open and (self.open[-1][0] == "p" or tag == self.open[-1][0] and tag in _HEADINGS_AND_TEXT):
            self._close()
        if tag == "hr":
            return
        framed = _framed(tag, attributes, self.articles > 0)
        if framed == NAMED and not self.framed:
            self.named += (self.blocks,)
            self.blocks += 1
        elif framed == NAMED:
            framed = 0
        if framed and not self.framed:
            self.lines += [("", 0, False, self.named)] * EMPTY_LINES
        if tag in _TITLED and not self.framed:
            self.titles.append(self.named)
        self.open.append((tag, framed))
        self.framed += framed == HARD
        self.articles += tag in ("article", "main")

    def _close(self) -> None:
        tag, framed = self.open.pop()
        self.framed -= framed == HARD
        if framed == NAMED:
            self.named = self.named[:-1]
        self.articles -= tag in ("article", "main")
        self.links = 0

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in _BLOCKS:
            return
        self.flush()
        if any(name == tag for name, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def unframed(self) -> list[tuple[str, int, bool]]:
        """The lines with frame blocks as empty lines.

        A named block stays if it holds an article, main or h1. If none stands outside it, it stays too with most of the text, and
        otherwise where the text outside is neither a surge nor OTHER_SHARE of its own: long comments stay frame.
        """
        total, held = 0, [0] * self.blocks
        for _, size, _, named in self.lines:
            total += size
            for k in named:
                held[k] += size
        around = [sum(k in named for named in self.titles) for k in range(self.blocks)]
        frame = [
            not titles and (2 * size <= total if not self.titles else total - size >= min(SURGE, OTHER_SHARE * size))
            for titles, size in zip(around, held)
        ]
        return [
            (text, size, inside)
            for text, size, inside, named in self.lines
            if not any(frame[k] for k in named) or not text and frame[named[-1]] and not any(frame[k] for k in named[:-1])
        ]


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    out, at = _Lines(), 0
    while True:
        low = page.find("<", at)
        if low < 0:
            out.text(page[at:])
            break
        out.text(page[at:low])
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = _TAG.match(page, low)
        if not m:
            mark = page[low + 1 : low + 2]
            if mark in ("!", "?", "/"):
                end = page.find(">", low)
                at = len(page) if end < 0 else end + 1
            else:
                out.text("<")
                at = low + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            out.end(tag)
            continue
        if tag in _RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if close is None:
                at = len(page)
            else:
                end = page.find(">", close.start())
                at = len(page) if end < 0 else end + 1
            continue
        out.begin(tag, m[3])
    out.flush()
    return out.unframed()


def main_text(page: str | None) -> str:
    """The kept lines, joined by an empty line; empty where there is no text."""
    lines = page_lines(page or "")
    if any(inside and size for _, size, inside in lines):
        return "\n\n".join(text for text, _, inside in lines if inside and text)
    sizes = [size for _, size, _ in lines]
    sums = [sum(sizes[k : k + WINDOW]) for k in range(len(sizes))]
    sections, k = [], 0
    while k < len(lines):
        if not sums[k]:
            k += 1
            continue
        begin = k
        while k < len(lines) and sums[k]:
            k += 1
        # windows look ahead: the section ends with its last line that has text, and begins at its first
        first = next(j for j in range(begin, k) if sizes[j])
        sections.append((sum(sizes[first:k]), max(sums[begin:k]) >= SURGE, first, k))
    surging = [s for s in sections if s[1]] or sections
    if not surging:
        return ""
    most = max(s[0] for s in surging)
    kept = [lines[j][0] for total, _, first, after in surging if total >= OTHER_SHARE * most for j in range(first, after)]
    return "\n\n".join(t for t in kept if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row; a null html gives an empty text."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    found = pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {types['page_id']}, url {types['url']}, text string"
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))

"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser streams a page's events into lines, one per block. Each line has its
text-to-tag ratio: characters per tag met since the line before. The ratios of a page are smoothed with a
Gaussian; lines that reach the threshold (a share of the standard deviation) both smoothed and on their own are dense.
Runs of lines between the first and the last dense line of a block are the content clusters, and they select the region of the page: from the page
down, the block that holds nearly all characters of dense lines, as long as one block does. Blocks of several lines beside it, of the same tag and with dense lines too, belong to the region.

From the region all lines stay, short ones and headings too, but for blocks at its edges that have no dense line and are
links, or stand in no block but the page's; of a page most of whose text stands in no block, the div and section blocks at its edges go. Where the region doesn't begin with a heading, one of the first rank (else of the second) that stands before it, with no dense line between, stays with what follows.
Tags are a hint only: characters of lines inside article and main count HINT times, the region grows to the article around it, and comes with the articles beside it.
Menus, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role or name before ratios are
taken. A name counts if it is one of the known ones or one with a known ending (`share-buttons`, `comment-list`), so that `share-price` and `related-work` stay.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
one newline. Defined cases: a page whose whole text stands in a form is read as if that were a block; a null or empty page has an empty text, as has a page without content lines;
unclosed tags end with their parent; equal rows get equal rows; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import per_text

SIGMA = 1.0
#: Threshold on ratios, as a multiple of the standard deviation of the smoothed ones.
THRESHOLD = 0.5
#: Share of a block's dense characters that one block inside must hold to be the region in its place.
SHARE = 0.9
#: The same for the page itself, whose blocks are its layout.
PAGE_SHARE = 0.5
#: What a character inside article or main counts.
HINT = 3
#: Share of links from which an edge block counts as one of links.
LINKS = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"))
_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr td th figcaption caption summary legend".split())
_PAGE = frozenset(("html", "body"))
_RANKS = {"h1": 1, "h2": 2}
_NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe object svg canvas audio video menu dialog".split())
_REGION = frozenset(("article", "main"))
# Names that pages give to what isn't their text, and endings that such names take.
_NAMES = (
    "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|sidebar|menu|nav|navbar|navigation|"
    "adsbygoogle|adsense|adbox|adslot|adunit|advertorial|breadcrumb|breadcrumbs|footer|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|"
    "social|related|recommended|comment|comments|commentlist|disqus|reply|replies|respond|widget|toolbar|pagination|pager|masthead|skip-link"
)
_ENDINGS = (
    "area|banner|bar|block|body|bottom|box|btns?|buttons?|card|cards|container|content|feed|footer|form|group|header|icons?|inner|items?|"
    "left|links?|list|menu|message|nav|notice|outer|panel|popup|posts?|articles?|stories|right|row|section|sidebar|slot|text|thread|tools|top|unit|widget|wrap|wrapper|[0-9]+"
)
_PLACES = "article|bottom|footer|global|header|left|main|mobile|page|post|primary|reader|right|secondary|side|site|sticky|top|user"
_BOILERPLATE = re.compile(rf"(?:(?:{_PLACES})[-_]+)*(?:{_NAMES})(?:[-_]+(?:{_NAMES}|{_ENDINGS}))*")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())


@dataclass
class Block:
    """A tag that holds other blocks. article: the article or main element around it or itself, -1 without."""

    tag: str
    above: int
    article: int
    is_header: bool


@dataclass
class Line:
    text: str
    tags: int
    links: int  # characters inside a elements
    block: int
    rank: int  # 1 and 2 for headings of these ranks, else 0


class LineParser(HTMLParser):
    """Collects lines and the blocks around them, boilerplate left out. Block 0 is the page."""

    def __init__(self, never: frozenset[str] = _NEVER) -> None:
        super().__init__(convert_charrefs=True)
        self.never, self.has_form = never, False
        self.lines: list[Line] = []
        self.blocks = [Block("", -1, -1, False)]
        self.pieces: list[str] = []
        self.tags = self.links = 0
        self.open: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, inside boilerplate, block
        self.count: Counter = Counter()  # of open tags, so that a tag that isn't open is never looked for
        self.links_at: list[int] = []  # where links stand among the open tags

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.links, self.open[-1][2], next((_RANKS[tag] for tag, _, _ in self.open[-3:] if tag in _RANKS), 0)))
            self.tags = 0
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
            if tag in _CLOSES_P:
                self.close_through(("p",), stop=_BLOCK)
            if tag in _ITEM:
                self.close_through(_ITEM[tag], stop=frozenset(("ul", "ol", "dl", "table", "menu")))
        if tag in _VOID:
            return
        if tag == "a":  # links hold no links
            self.close_through(("a",), stop=_BLOCK)
        _, out, block = self.open[-1]
        named = dict(attrs)
        out = out or self.is_boilerplate(tag, named)
        if tag in _BLOCK - _LEAF - _PAGE and not out:
            article = self.blocks[block].article
            self.blocks.append(Block(tag, block, len(self.blocks) if article < 0 and tag in _REGION else article, self.is_header(tag, named)))
            block = len(self.blocks) - 1
        if tag == "a" and named.get("href") is not None:
            self.links_at.append(len(self.open))
        self.open.append((tag, out, block))
        self.count[tag] += 1

    def close_from(self, k: int) -> None:
        """Open tags from the k-th on are closed."""
        self.count.subtract(tag for tag, _, _ in self.open[k:])
        del self.open[k:]
        while self.links_at and self.links_at[-1] >= k:
            self.links_at.pop()

    def is_boilerplate(self, tag: str, attrs: dict[str, str | None]) -> bool:
        self.has_form |= tag == "form"
        if tag in self.never or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        if tag in _PAGE:
            return False
        if (attrs.get("role") or "").lower() in _ROLES:
            return True
        return any(_BOILERPLATE.fullmatch(x) for x in names_of(attrs))

    def is_header(self, tag: str, attrs: dict[str, str | None]) -> bool:
        return tag == "header" or any(re.fullmatch(r"(?:site|page|top)?[-_]?header", x) for x in names_of(attrs))

    def close_through(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                self.close_from(k)
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.close_from(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1]:
            self.pieces.append(data)
            if self.links_at:
                self.links += len(data.strip())


def names_of(attrs: dict[str, str | None]) -> list[str]:
    return f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach), kernel / kernel.sum(), mode="valid")


def dense_lines(lines: list[Line], sigma: float, threshold: float) -> np.ndarray:
    raw = np.array([len(x.text) / max(1, x.tags) for x in lines])
    ratio = smoothed(raw, sigma)
    least = threshold * ratio.std()
    dense = (ratio >= least) & (raw >= least)
    return dense if dense.any() else ratio == ratio.max()


class Region:
    """The blocks that a page's dense lines select."""

    def __init__(self, lines: list[Line], blocks: list[Block], dense: np.ndarray, share: float = SHARE, hint: float = HINT):
        self.lines, self.blocks, self.dense = lines, blocks, dense
        self.inside: list[list[int]] = [[] for _ in blocks]  # blocks directly inside
        for n, b in enumerate(blocks[1:], 1):
            self.inside[b.above].append(n)
        self.mass, self.held = np.zeros(len(blocks)), np.zeros(len(blocks), int)
        links, chars = np.zeros(len(blocks)), np.zeros(len(blocks))
        for x, is_dense in zip(lines, dense, strict=True):
            self.mass[x.block] += is_dense * len(x.text) * (hint if blocks[x.block].article >= 0 else 1)
            self.held[x.block] += 1
            links[x.block] += x.links
            chars[x.block] += len(x.text)
        for n in range(len(blocks) - 1, 0, -1):  # blocks come after those around them
            for of in (self.mass, self.held, links, chars):
                of[blocks[n].above] += of[n]
        self.is_links = links >= LINKS * np.maximum(chars, 1)
        self.top = self.chosen(share)
        article = blocks[self.top].article
        if article >= 0:
            self.top = article
        # one pass down the blocks: those of the region, and of the region the child of its top that each is in
        self.tops = {self.top} | self.beside()
        self.branch = np.full(len(blocks), -1)
        for n in range(len(blocks)):
            above = blocks[n].above
            if n in self.tops:
                self.branch[n] = n
            elif above >= 0 and self.branch[above] >= 0:
                self.branch[n] = n if above in self.tops else self.branch[above]

    def chosen(self, share: float) -> int:
        at = 0
        while self.inside[at]:
            most = max(self.inside[at], key=lambda n: self.mass[n])
            own = self.mass[at] - self.mass[self.inside[at]].sum()
            least = share if at or self.held[most] < 2 else PAGE_SHARE
            if self.mass[most] < least * self.mass[at] or own > (1 - share) * self.mass[at] or (at and self.held[most] < 2):
                break
            at = most
        return at

    def beside(self) -> set[int]:
        top = self.blocks[self.top]
        if top.above < 0:
            return set()
        return {n for n in self.inside[top.above] if self.blocks[n].tag == top.tag and (self.mass[n] > 0 and self.held[n] > 1 or top.tag == "article") and not self.blocks[n].is_header}

    def kept(self) -> np.ndarray:
        branch = np.array([self.branch[x.block] for x in self.lines])
        keep = branch >= 0
        within = np.flatnonzero(keep & self.dense)
        first, last = (within[0], within[-1]) if len(within) else (0, len(self.lines))
        is_page = self.top == 0
        layout = np.zeros(len(self.blocks), bool)  # blocks of a page whose text stands in no block, or most of it
        if is_page and 2 * self.mass[self.inside[0]].sum() < self.mass[0]:
            own = within[branch[within] == 0]
            first, last = own[0], own[-1]
            layout[[n for n in self.inside[0] if self.blocks[n].tag in ("div", "section", "center")]] = True
        for k in np.flatnonzero(keep):
            n = branch[k]
            if n in self.tops or first < k < last or (self.mass[n] > 0 and not layout[n]) or self.blocks[n].article >= 0:
                continue
            # a block at the region's edge, without a dense line
            keep[k] = not (is_page or self.is_links[n] or (self.blocks[n].is_header and not self.has_title(n)))
        start = int(np.argmax(keep)) if keep.any() else 0
        title = self.title_before(start) if keep.any() and not self.lines[start].rank else None
        if title is not None:
            keep[title:start] |= ~np.array([bool(self.is_links[x.block]) for x in self.lines[title:start]])
        return keep

    def title_before(self, start: int) -> int | None:
        """The last heading of the first rank before the region, else of the second, with no dense line between."""
        found: dict[int, int] = {}
        for k in range(start - 1, -1, -1):
            if self.dense[k]:
                break
            if self.lines[k].rank and not self.is_page_header(self.lines[k].block):
                found.setdefault(self.lines[k].rank, k)
        return found.get(1, found.get(2))

    def has_title(self, n: int) -> bool:
        return any(x.rank == 1 and self.is_under(x.block, n) for x in self.lines)

    def is_under(self, n: int, above: int) -> bool:
        while n > above:
            n = self.blocks[n].above
        return n == above

    def is_page_header(self, n: int) -> bool:
        while n > 0:
            if self.blocks[n].is_header:
                return self.blocks[n].above == 0
            n = self.blocks[n].above
        return False


def parsed(html: str, never: frozenset[str]) -> LineParser:
    parser = LineParser(never)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD, share: float = SHARE, hint: float = HINT) -> str:
    parser = parsed(html, _NEVER)
    if not parser.lines and parser.has_form:
        parser = parsed(html, _NEVER - {"form"} | {"label"})
    if not parser.lines:
        return ""
    keep = Region(parser.lines, parser.blocks, dense_lines(parser.lines, sigma, threshold), share, hint).kept()
    return "\n".join(x.text for x, k in zip(parser.lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: id, url, text and n_chars."""

    def make() -> Callable[[str], tuple]:
        def fn(page: str) -> tuple:
            text = main_text(page)
            return text, len(text)

        return fn

    return per_text(pages, [page_id, url], html, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)

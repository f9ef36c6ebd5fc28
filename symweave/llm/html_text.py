"""Main text of HTML pages: flat text blocks classified by a small decision tree.

A page is read once into a flat list of blocks, the stretches of text between block-level tags.
A block has its number of words and the density of words inside links, and the same numbers of its
two neighbours. Beside these stand what markup says of it: whether it is in an element that holds no
main text by tag or role, what its surroundings are called and how much of the page's text is so
called, whether it stands inside the page's article or outside of one, and, on pages that mark
none, apart from the innermost element that holds most of the text. A decision tree, grown at first
use from the blocks of the labelled pages in this module, says which blocks are content.

White space inside a block becomes one space; character references are decoded; content blocks
are joined by a line feed in page order. Nothing else is dropped or cut.

Defined results: a null, empty or text-free page has the empty text; broken and unclosed markup
is read as far as it goes, and a tag that the page's end cuts off is no text; very long pages are
read whole, in time that grows with their length, however deep they nest; repeated rows come out
as often as they went in, alike; an empty table gives an empty result; other columns pass through,
and columns called like the results, in any case, are replaced.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import small_batches, table, tidied

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW_TAGS = frozenset("script style noscript template iframe object svg math canvas textarea title select button head audio video noframes noembed xmp plaintext".split())
#: Of these the content is not markup either, up to their end tag.
CDATA_TAGS = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: An open element of the first kind ends where one of the second begins.
IMPLIED_END = {
    "p": BLOCK_TAGS - {"body", "html", "option", "optgroup"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
}
#: Surroundings that hold no main text, by tag, by role, and by words of class and id.
BOILER_TAGS = frozenset("nav footer aside form menu dialog search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adslot sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar sidebars footer foot footnotes masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist comments-area disqus respond reply replies discussion share sharing social related "
    "recommended recommendations widget widgets pagination pager copyright disclaimer alert alerts skip paywall feedback legal privacy tags taglist".split()
)
#: Of these, the ones that an element of an article's own text may be called as well: words and density decide there.
WEAK_WORDS = frozenset(
    "alert alerts notice notices legal privacy disclaimer copyright feedback social related discussion tags foot footnotes skip share sharing consent promotion "
    "recommended recommendations reply replies respond".split()
)
#: Parts of a name that say nothing of what the element holds; the part before them does.
PLAIN_PARTS = frozenset(
    "area articles bar block box button buttons card cards col column container content form group head header inner item items left line link links list main "
    "outer panel posts primary right row secondary section slot stories story text title top bottom unit wrap wrapper zone".split()
)
#: Of BOILER_WORDS, the ones that an article element itself may be.
COMMENT_WORDS = frozenset("comment comments reply ad advert advertisement sponsored promo".split())
ARTICLE_TAGS = frozenset({"article", "main"})
ARTICLE_WORDS = frozenset("article content main post entry story body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|</?[a-zA-Z][^>]*\Z", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[^\W_]+")
_CLASS_PART = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*", re.ASCII)
#: A class that says what its element has or lacks, not what it is.
_ABOUT = re.compile(r"(?<![^\s])(?:has|with|no|without|show|hide|is)-\S+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    words: int = 0
    linked: int = 0
    element: int = 0
    boiler: bool = False
    #: 1: so called; 0.5: by a weak word, inside the article; and by which element
    named: float = 0.0
    namer: int = 0
    article: bool = False
    #: the article element inside an article that it is in
    nested: int = 0
    heading: bool = False
    item: bool = False

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Open:
    tag: str
    boiler: bool
    named: float
    namer: int
    article: bool
    nested: int
    hidden: bool
    number: int = 0


_ROOT = _Open("", False, 0.0, 0, False, 0, False)


class _Page:
    """Open elements, and all elements by number in the order of their start tags."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[_Open] = []
        #: places in the stack, by tag and of the block-level elements
        self.places: dict[str, list[int]] = {}
        self.levels: list[int] = []
        self.parts: list[tuple[str, bool]] = []
        self.tags, self.parents, self.ends = [""], [0], [0]

    @property
    def links(self) -> bool:
        return bool(self.places.get("a"))

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _ROOT

    def flush(self) -> None:
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        text = " ".join("".join(t for t, _ in parts).split())
        if not text:
            return
        top = self.top()
        tags = {o.tag for o in self.stack[-4:]}
        linked = sum(len(_WORDS.findall(t)) for t, link in parts if link)
        words = max(1, len(_WORDS.findall(text)))
        self.blocks.append(
            Block(text, words, min(linked, words), top.number, top.boiler, top.named, top.namer, top.article, top.nested, bool(tags & _HEADINGS), bool(tags & {"li", "td", "th", "option"}))
        )

    def open(self, element: _Open) -> None:
        element.number = len(self.tags)
        if element.namer < 0:
            element.namer = element.number
        if element.nested < 0:
            element.nested = element.number
        self.tags.append(element.tag)
        self.parents.append(self.top().number)
        self.ends.append(0)
        self.places.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in BLOCK_TAGS:
            self.levels.append(len(self.stack))
        self.stack.append(element)

    def close(self, at: int) -> None:
        """End the open elements from place `at` on."""
        if self.levels and self.levels[-1] >= at:
            self.flush()
        while len(self.stack) > at:
            o = self.stack.pop()
            self.places[o.tag].pop()
            if o.tag in BLOCK_TAGS:
                self.levels.pop()
            self.ends[o.number] = len(self.tags)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def _is_named(names: str, words: frozenset[str]) -> bool:
    """Whether a name is one of the words, or one of them and plain parts behind it, or ends with one."""
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
        while len(parts) > 1 and parts[-1] in PLAIN_PARTS:
            parts.pop()
        if name in words or parts and parts[-1] in words:
            return True
    return False


def _surroundings(tag: str, raw: str, above: _Open, in_article: bool) -> _Open:
    """The element; a negative namer or nested is its own number, which it gets when it is opened."""
    o = _Open(tag, above.boiler, above.named, above.namer, above.article, above.nested, above.hidden)
    if tag == "article" and in_article and not above.nested:
        o.nested = -1
    if tag in ARTICLE_TAGS:
        o.article = True
    # a header of the page holds no main text; one inside the article has its title
    if tag in BOILER_TAGS or tag == "header" and not o.article:
        o.boiler = True
    if tag in RAW_TAGS:
        o.hidden = True
    if raw and not raw.isspace():
        a = _attributes(raw)
        names = _ABOUT.sub(" ", f"{a.get('class', '')} {a.get('id', '')}".lower())
        words = {w for x in _CLASS_PART.findall(names) for w in (x, *x.split("-"))} | set(re.split(r"[_\s]+", names))
        role = a.get("role", "").lower()
        # ids of headings and of an article's sections are anchors made of their titles
        anchor = tag in _HEADINGS or o.article and (tag == "section" or "section" in words)
        called = _ABOUT.sub(" ", (a.get("class", "") if anchor else f"{a.get('class', '')} {a.get('id', '')}").lower())
        known = COMMENT_WORDS if tag in ARTICLE_TAGS else BOILER_WORDS
        if role in BOILER_ROLES:
            o.boiler = True
        if tag not in ("body", "html") and _is_named(called, known - WEAK_WORDS if o.article and tag not in ARTICLE_TAGS else known):
            if o.named < 1:
                o.named, o.namer = 1.0, -1
        elif o.article and tag not in ("body", "html", *ARTICLE_TAGS) and _is_named(called, WEAK_WORDS):
            if not o.named:
                o.named, o.namer = 0.5, -1
        elif tag in ("div", "section", "td") and words & ARTICLE_WORDS or role in ("main", "article"):
            o.article = True
        if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "").lower()):
            o.hidden = True
    return o


def read_page(source: str | None) -> _Page:
    """The page's blocks in order, and its elements."""
    page, at, source = _Page(), 0, source or ""
    stack, places = page.stack, page.places

    def text(upto: int) -> None:
        if upto > at and not page.top().hidden:
            page.parts.append((html.unescape(source[at:upto]), page.links))

    while found := _TOKEN.search(source, at):
        text(found.start())
        at = found.end()
        closing, tag, raw = found[1], (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        if closing:
            if places.get(tag):
                place = places[tag][-1]
                # an inline end tag does not reach out of the block that it stands in
                if tag in BLOCK_TAGS or tag in RAW_TAGS or not (page.levels and page.levels[-1] > place):
                    page.close(place)
            elif tag == "p":
                page.flush()
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                page.flush()
            elif tag == "br" and not page.top().hidden:
                page.parts.append((" ", page.links))
            continue
        if tag in BLOCK_TAGS:
            # only inline elements stand between it and what it ends
            if page.levels and tag in IMPLIED_END.get(stack[page.levels[-1]].tag, ()):
                page.close(page.levels[-1])
            page.flush()
            # inline elements that were left open end with their block
            while stack and stack[-1].tag not in BLOCK_TAGS and stack[-1].tag not in RAW_TAGS and stack[-1].tag not in ("a", "span"):
                page.close(len(stack) - 1)
        if tag == "a" and page.links:
            page.close(places["a"][-1])
        if raw.endswith("/") and tag in ("svg", "math", "path", "use"):
            continue
        if tag in CDATA_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            continue
        page.open(_surroundings(tag, raw, page.top(), bool(places.get("article"))))
    text(len(source))
    page.flush()
    page.close(0)
    return page


FEATURES = (
    "boiler", "named", "share", "inside", "outside", "apart", "nested", "rights", "heading", "item",
    "words", "density", "words_before", "density_before", "words_after", "density_after",
)

#: The least share of a page's text that an article has, and that the element has which stands for one.
LEAST_ARTICLE, MOST_OF_TEXT = 0.2, 0.7
_CONTAINERS = frozenset("div section td center main body dd fieldset".split())
_RIGHTS = re.compile(r"\u00a9|\(c\) ?\d{4}|\ball rights reserved\b|\bcopyright\b", re.IGNORECASE)
_RIGHTS_CHARS = 200


def _subtree_sums(page: _Page, own: list[float]) -> list[float]:
    """Of each element's own numbers, the sums with all elements inside it."""
    total = list(own)
    for i in range(len(total) - 1, 0, -1):
        total[page.parents[i]] += total[i]
    return total


def features(page: _Page) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block."""
    blocks, size = page.blocks, len(page.tags)
    plain, many = [0.0] * size, [0.0] * size
    for b in blocks:
        if not b.boiler:
            plain[b.element] += b.words - b.linked
            many[b.element] += 1
    plain, many = _subtree_sums(page, plain), _subtree_sums(page, many)
    free = sum(b.words - b.linked for b in blocks if not b.boiler and b.named < 1)
    in_article = sum(b.words - b.linked for b in blocks if b.article and not b.boiler and b.named < 1)
    article = any(b.article and not b.boiler for b in blocks) and in_article >= LEAST_ARTICLE * free
    # articles inside the article are comments on it, unless one of them has more text than all outside them
    inner = max((plain[b.nested] for b in blocks if b.nested), default=0.0)
    comments = sum(b.words - b.linked for b in blocks if b.article and not b.nested and not b.boiler) >= inner
    most, most_end = 0, size
    if not article:
        held = [i for i in range(1, size) if page.tags[i] in _CONTAINERS and many[i] > 1 and plain[i] >= MOST_OF_TEXT * max(plain[0], 1)]
        if held:
            most, most_end = held[-1], page.ends[held[-1]]
    none, out = Block(""), []
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else none, blocks[i + 1] if i + 1 < len(blocks) else none
        out.append((
            b.boiler, b.named, plain[b.namer] / max(plain[0], 1) if b.named else 0.0,
            article and b.article, article and not b.article, not most <= b.element < most_end, comments and b.nested > 0,
            len(b.text) <= _RIGHTS_CHARS and bool(_RIGHTS.search(b.text)), b.heading, b.item,
            b.words, b.density, before.words, before.density, after.words, after.density,
        ))
    return out


# The labelled table, pages whose blocks were judged by hand, one page a line. A block is
# its label (+ is content), its number of words, and behind an "a" how many of them are linked; "r" has a rights notice.
LABELLED = """
<nav><ul><li>-1a1<li>-1a1<li>-2a2</ul></nav><div class="ad">-12</div><article><h1>+9</h1><p>+40</p><p>+1</p><p>+120</p><p>+3</p><p>+6</p></article><footer>-9r</footer>
<header><h1>-3a3</h1><p>-8</p></header><main><h1>+6</h1><p>+25</p><h2>+2</h2><p>+80a6</p><ul><li>+4</li><li>+14a2</li><li>+3a3</li><li>+9</li></ul><p>+2</p></main><aside><h3>-2</h3><p>-30</p><ul><li>-5a5</li><li>-6a6</li></ul></aside><footer><p>-14r</p><p>-3a3</p></footer>
<nav>-6a6</nav><form>-4</form><article><p>+2</p><p>+60</p><p>+8</p><p>+35</p><form><p>-10</p></form><p>+5</p><aside><p>-15</p></aside><p>+90</p><nav><ul><li>-3a3</li></ul></nav></article>
<article><h1>+5</h1><p>+60</p><ul><li>-5a5</li><li>-4a4</li><li>-6a6</li></ul><p>+50</p></article>
<article><h1>+8</h1><p>+2a2</p><p>+70</p><p>+20</p><ul><li>-8a8</li><li>-3a3</li><li>-7a7</li><li>-5a5</li></ul></article><div>-12</div>
<main><h1>+4</h1><p>+3a1</p><p>+150</p><h2>+3</h2><p>+45a9</p><p>+3a3</p><p>+40</p><ol><li>+12</li><li>+6a1</li><li>+25</li></ol><p>-2a2</p><p>-2a2</p></main>
<article><p>+12</p><table><tr><th>+1<th>+2<tr><td>+1<td>+1a1<tr><td>+3<td>+2</table><p>+18</p><blockquote><p>+30</p></blockquote><p>+4</p><p>+1</p></article><div><p>-25</p></div>
<div>-20</div><article><h1>+7</h1><p>+300</p><p>+10</p><p>+12r</p></article><div><h2>-3</h2><p>-110</p><p>-5</p><p>-60</p></div><div><ul><li>-2a2</li><li>-7</li></ul></div>
<div><h3>-4</h3><p>-45</p></div><main><p>+15</p><p>+80</p></main><div>-8</div><ul><li>-2a2</li><li>-2a2</li></ul><p>-2</p>
<article><h1>+8</h1><p>+120</p><p>+60</p><section><article><p>-3</p><p>-20</p></article><article><h4>-2</h4><p>-9</p></article><article><p>-55</p></article></section></article>
<main><article><h1>+5</h1><p>+30</p><p>+40</p></article><article><h1>+4</h1><p>+50</p><p>+6</p></article></main>
<article><h1>+5</h1><p>+60</p><div class="notice"><p>+150</p></div><p>+60</p><div class="share">-3</div><p>+40</p><div class="related"><ul><li>-6a6</li><li>-5a5</li></ul></div><div class="tags">-2a2</div></article>
<article><p>+40</p><div class="notice"><p>-5</p></div><p>+40</p><div class="disclaimer"><p>+30</p></div><p>+50</p><div class="footnotes"><p>+25a2</p></div><div class="recommended"><h3>-2</h3><p>-30a27</p><p>-6a6</p></div></article>
<article><h1>+6</h1><p>+90</p><div class="alert"><p>+60</p></div><p>+5</p><div class="feedback"><p>-8</p></div><div class="social"><ul><li>-1a1</li><li>-2a2</li></ul></div><p>+30</p><div class="copyright"><p>-9r</p></div></article>
<article><div class="privacy"><p>+28</p></div><p>+45</p><div class="reply"><p>-7</p></div><p>+70</p><div class="tags"><p>-9a8</p></div></article>
<article><h1>+5</h1><p>+60</p><div class="ad">-15</div><p>+50</p><div class="ad">-3a3</div><p>+90</p><section class="comments"><h2>-2</h2><p>-25</p><p>-45</p><p>-6</p></section></article>
<article><p>+30</p><div class="newsletter"><p>-20</p></div><p>+45</p><div class="sidebar"><h3>-2</h3><p>-60</p></div><p>+12</p><div class="cookie-banner"><p>-35</p></div></article>
<div class="navbar">-5a5</div><div class="cookie-notice"><p>-18</p></div><div><h1>+6</h1><p>+75</p><p>+8</p><p>+30</p><div class="ad">-40</div><p>+55</p></div><div class="comments"><p>-30</p><p>-12</p></div><div class="footer">-8r</div>
<div class="menu"><ul><li>-1a1</li><li>-1</li></ul></div><p>+40</p><p>+4</p><div class="sponsored"><p>-22</p></div><p>+65</p><div class="reader-comments"><p>-90</p><p>-4</p></div>
<div class="newsletter"><h1>+6</h1><p>+90</p><p>+150</p><p>+12</p><p>+80</p></div><div>-6r</div>
<div class="widget comments"><p>+200</p><p>+7</p><p>+45</p></div><ul><li>-1a1</li><li>-1a1</li></ul>
<div>-5a5</div><div><h1>+7</h1><p>+45</p><p>+3</p><p>+70</p><p>+12</p></div><div>-7r</div>
<div><div>-2a2</div><div>-2a2</div><div>-1</div></div><div><div><h1>+6</h1><p>+30</p><p>+155a4</p><h2>+3</h2><p>+20</p><ul><li>+6</li><li>+8</li></ul><p>+5</p></div><div><p>-3</p><p>-11</p></div></div><div><p>-8</p><p>-2a2</p><p>-6r</p></div>
<div><h1>-2</h1><ul><li>-1a1</li><li>-1a1</li><li>-1a1</li></ul></div><div><h1>+9</h1><p>+110</p><p>+25</p><p>+1</p><p>+60</p></div><div><h3>-2</h3><p>-14</p><p>-4</p><p>-35</p><p>-6</p></div>
<div><h1>+8</h1><p>+45</p></div><div><p>+80</p><p>+60</p><p>+90</p><p>+70</p></div><div>-7</div>
<div><h1>+5</h1></div><div><p>+50</p><p>+30</p><p>+2</p><p>+9</p></div><div><p>-18</p></div><div><p>-3a3</p><p>-3a3</p></div>
<div>-12</div><div><p>+140</p><p>+60</p><p>+5</p></div><div><p>-9</p><p>-28</p></div><div>-4</div>
<ul><li>-1a1<li>-1a1</ul><p>+12</p>
<p>+3</p><p>+50</p><p>+2</p>
<p>-4a4</p><h1>+6</h1><p>+40</p><p>+25a2</p><p>+8</p><p>-6r</p>
<h1>+3</h1><p>+20</p><p>+5</p><p>+3</p>
<p>+1</p><p>+1</p><p>+1</p>
<p>+4</p>
<p>+1</p><p>+2</p><p>+15</p><p>+30</p><p>+1</p><p>+4</p>
<p>+30</p><p>+3a3</p><p>+40</p><p>-6a6</p><p>-3a3</p>
<h1>+7</h1><p>+60</p><h2>+3</h2><p>+40</p><ul><li>+12</li><li>+6a1</li><li>+15</li></ul><p>+150a15</p><p>+30</p><p>-2a2</p><p>-3a2</p>
<table><tr><td>+1<td>+3<tr><td>+2<td>+1</table><p>+9</p>
<p>-3a2</p><p>-8a7</p><p>+60</p><p>+20a4</p><p>+30</p><p>+25r</p><p>+40</p><p>-30a21</p><p>-6a5</p>
<ul><li>-2a2</li><li>-3a3</li><li>-4a3</li></ul><h1>+5</h1><p>+35</p><p>+10</p><ul><li>-10a8</li><li>-9a9</li></ul><p>-11r</p>
<article><h1>+5</h1><p>+900</p><div class="notice"><p>+40</p></div><p>+300</p><div class="disclaimer"><p>-9</p></div><div class="notice"><p>+24</p></div><p>+45</p></article>
<article><p>+20</p><div class="notice"><p>-6</p></div></article>
<article><p>+30</p><div class="alert"><p>-10</p></div><p>+6</p><div class="legal"><p>+33</p></div></article>
<article><h2>+4</h2><p>+60</p><ul><li>-3a3</li><li>-2a2</li><li>-4a4</li></ul><p>+70</p><ul><li>-1a1</li><li>-1a1</li></ul><p>+45</p><p>+2a2</p><p>+38</p><ul><li>-9a9</li><li>-2a2</li></ul><p>+12</p></article>
<main><p>+15</p><ul><li>-6a6</li><li>-12a12</li></ul><p>+100</p><p>+1a1</p><p>+30</p><ul><li>+2</li><li>+5a5</li><li>+7</li></ul><h3>+2</h3><p>+4a4</p><p>+60</p></main>
<article><h1>+6</h1><p>+80</p><p>+6r</p><p>+40</p><p>+30a3</p><p>+9r</p></article>
<p>+70</p><p>+45</p><p>-16r</p>
<h1>+4</h1><p>+100</p><p>+28r</p><p>+60</p><p>-25r</p><p>-2a2</p>
<div><h1>+6</h1></div><div><p>+150</p><p>+40</p><p>+70</p></div><div>-3</div><div>-25</div>
<div><h2>+3</h2></div><div>-5</div><div><p>+60</p><p>+40</p><p>+80</p></div><div><h3>-4</h3></div><div>-9</div>
<div>-10</div><div><p>+70</p><p>+90</p><p>+14</p></div><div>-30</div><div>-15</div>
<div>-3</div><div><h1>+8</h1><p>+50</p><p>+12</p><p>+95</p></div><div><p>-22</p><p>-38</p><p>-3</p></div><div>-6a5</div>
<div>-2</div><div>-18</div><div><h1>+7</h1><p>+120</p><p>+60</p></div><div><p>-2</p></div>
<div><h1>+7</h1><p>+60</p></div><div><p>+130</p><p>+160</p><p>+50</p></div><div>-20</div>
<div><p>+40</p></div><div><p>+100</p><p>+60</p><p>+20</p></div>
<div><h1>-3</h1></div><div>-6a6</div><div><p>+60</p><p>+40</p><p>+80</p></div><div>-2a2</div>
<h1>+6</h1><p>+55</p><p>+40</p><div class="comments"><p>-50</p><p>-20</p></div><p>+15</p>
<div><p>+60</p><p>+20</p></div><div class="discussion"><p>-45</p><p>-8</p><p>-25</p></div>
<div class="promo"><p>+50</p><p>+6</p><p>+40</p></div><p>-4a4</p>
<article><p>+150</p><div class="comments"><p>-150</p><p>-100</p><p>-30</p></div><p>+40</p></article>
<article><div class="advert"><p>-120</p></div><p>+200</p><p>+80</p><div class="sponsored"><h3>-5</h3><p>-30a4</p></div><p>+60</p></article>
<article><p>+60</p><div class="share">-2a2</div><p>+45</p><div class="social">-1a1</div><p>+80</p><div class="related"><p>-40a40</p></div><p>+30</p><div class="ad">-5a5</div><p>+90</p><div class="tags">-4a4</div><p>+33</p></article>
"""
_BLOCK = re.compile(r"(?<![\w#])([+-])(\d+)(?:a(\d+))?(r?)(?![\w#])")


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features of the labelled pages' blocks, and whether they are content."""
    x, y = [], []
    for line in LABELLED.strip().splitlines():
        labels = [m[1] == "+" for m in _BLOCK.finditer(line)]

        def words(m: re.Match) -> str:
            plain, linked = int(m[2]) - int(m[3] or 0), int(m[3] or 0)
            return ("\u00a9 " if m[4] else "") + " ".join(["w"] * plain) + (f" <a href=x>{' '.join(['w'] * linked)}</a>" if linked else "")

        rows = features(read_page(_BLOCK.sub(words, line)))
        if len(rows) != len(labels):
            raise ValueError(f"{len(rows)} blocks for {len(labels)} labels: {line}")
        x += rows
        y += labels
    return np.array(x, float), np.array(y, int)


@dataclass
class Node:
    """A leaf has no feature."""

    content: bool
    feature: int = -1
    at: float = 0.0
    below: Node | None = None
    above: Node | None = None


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """CART: the split that lowers Gini impurity most; ties go to the first feature, lowest value."""
    leaf = Node(bool(y.mean() >= 0.5))
    if depth == 0 or y.all() or not y.any():
        return leaf
    best = (_gini(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= at
            cost = _gini(y[low]) + _gini(y[~low])
            if cost < best[0] - 1e-9:
                best = (cost, f, float(at))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Node(leaf.content, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@functools.cache
def tree() -> Node:
    return grow(*labelled_rows())


def is_content(x: tuple[float, ...]) -> bool:
    node = tree()
    while node.feature >= 0:
        node = node.below if x[node.feature] <= node.at else node.above
    return node.content


def main_text(source: str | None) -> str:
    page = read_page(source)
    return "\n".join(b.text for b, x in zip(page.blocks, features(page), strict=True) if is_content(x))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html and with text and n_chars, its code points; columns of these names are replaced."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")]
    read = pages.select(*[pages[f"`{c}`"] for c in kept], pages[f"`{column}`"])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(column).to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], [*kept, "text", "n_chars"])

    schema = [*[read.schema[c] for c in kept], StructField("text", StringType()), StructField("n_chars", LongType())]
    return read.mapInArrow(tidied(extracted), StructType(schema))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

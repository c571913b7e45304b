"""Main text of web pages by two passes of block rules.

A page is read once from start to end into blocks of text. Elements that are never
part of an article (by their tag, or by the words of their class, id or role) are left
out on the way. The first pass decides each block by its link density, its share of
stop words and its length; the second gives short, undecided blocks the label of their
nearest decided neighbours. Where a page marks its article, that is where blocks are
looked for: link lists go there, and parts whose class words may as well name a chapter
(a discussion, related work) are judged as strictly as on a page without marks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from offermarket.llm.frames import field as column
from offermarket.llm.textbytes import slices

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in is that it for on was with as be by at are this from or an not have but they his her which we
    de la le les et des en un une du est que qui dans pour pas sur au avec ne se ce il par plus sont
    der die und den das von zu mit sich ist im dem nicht ein eine als auch auf für werden wird bei
    el los las y del por con para una su al lo como más pero sus o este ya
    """.split()
)

RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select
    summary table tbody td tfoot th thead tr ul
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of an article.
NEVER = frozenset(
    "head nav footer aside form menu dialog button select option label fieldset legend object canvas audio video map".split()
)
#: Words of class, id or role that mark what surrounds an article ...
AROUND = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner
    billboard nav navbar navigation menu breadcrumb breadcrumbs crumbs pager pagination sidebar sidebars aside rail
    header masthead topbar footer foot copyright colophon cookie cookies consent gdpr notice notices notification
    notifications alert popup modal overlay newsletter subscribe subscription signup login signin register paywall
    comment comments commentlist commentary respond reply replies disqus discussion feedback related recommended
    recommendations teaser teasers share sharing social follow widget widgets toolbar search form tags hidden
    contentinfo complementary skip warning announcement disclaimer toast legal
    adbox adslot adunit adblock adcontainer adwrapper adsbygoogle
    """.split()
)
#: Of these, words that also name parts of an article: inside a marked one they only shift the thresholds.
HINTS = frozenset("discussion legal related recommendations commentary feedback warning search tags".split())
#: Endings of compounds such as topnav, mainmenu or usercomments that mark the same.
AROUND_ENDS = ("nav", "menu", "sidebar", "footer", "banner", "comments", "newsletter", "popup")
#: ... and those that mark the article itself, which weigh more.
INSIDE = frozenset("article content contents post entry story main maintext articlebody".split())
#: Class words that only point at a part, such as has-sidebar or with-comments, mark nothing.
POINTERS = frozenset("has with no without show hide is not overflow".split())

SHORT, LONG = 70, 200
LINKS_OUTSIDE, LINKS_INSIDE = 0.33, 0.75
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.12, 0.2

_TAG = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")
_CASES = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Element:
    tag: str
    out: bool  # it, or what it is in, is no part of an article
    article: int  # number of the innermost marked article around it, or -1
    link: bool
    doubted: bool = False  # it, or what it is in, has a name that may mark surroundings


@dataclass
class Block:
    """A run of text between two block boundaries."""

    out: bool
    article: int
    heading: str  # tag of the heading it is in, if any
    parent: int
    doubted: bool = False
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    label: str = ""


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes mark surroundings, for sure, and whether they mark an article."""
    names: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("hidden", "aria-hidden") and value.lower() in ("", "hidden", "true"):
            return True, True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, True, False
        if name in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
            names += value.split()
    around = sure = inside = False
    for name in names:
        words = set(_PART.findall(_CASES.sub("-", name).lower()))
        if words & POINTERS:
            continue
        words |= {"nav" for word in words if word.endswith(AROUND_ENDS)}
        if words & INSIDE and words & AROUND == {"header"}:
            continue  # it holds the title of an article
        # The comments of a post are no article.
        if words & AROUND:
            around = True
            sure = sure or not words & AROUND <= HINTS
        elif words & INSIDE:
            inside = True
    return around and not inside, sure and not inside, inside


def blocks_of(page: str) -> tuple[list[Block], list[tuple[str, int]]]:
    """The blocks of a page in order, and kind and surrounding one of its marked articles."""
    stack = [Element("", False, -1, False)]
    found: list[Block] = []
    articles: list[tuple[str, int]] = []
    parents = [0]
    count = 0
    current: Block | None = None
    line_break = False

    def add(text: str) -> None:
        nonlocal current, line_break
        if not text:
            return
        top = stack[-1]
        if current is None:
            if text.isspace():
                return
            heading = next((e.tag for e in reversed(stack) if e.tag in HEADINGS), "")
            current = Block(top.out, top.article, heading, parents[-1], top.doubted)
            found.append(current)
        if not text.isspace():
            line_break = False
        current.pieces.append(text)
        if top.link:
            current.linked.append(text)

    def pop(to: int) -> None:
        del stack[to:], parents[to:]

    at = 0
    while at < len(page):
        match = _TAG.search(page, at)
        # What looks like a tag but is not closed before the next one is text; at the end of a page it is cut off.
        end = match.start() if match else len(page)
        if end > at:
            add(html.unescape(page[at:end]))
        if not match:
            break
        at = match.end()
        closing, tag = match.group(1), (match.group(2) or "").lower()
        if not tag:
            continue
        if not closing and tag in RAW:
            # Raw text goes on to its own end tag, whatever is in it.
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            if line_break:
                current = None
            line_break = True
            add(" ")
            continue
        if tag in BLOCK:
            current, line_break = None, False
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop(depth)
                    break
                # An inline end tag does not close blocks.
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            _close_implied(tag, stack, pop)
        elif tag == "a":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in BLOCK:
                    break
                if stack[depth].tag == "a":
                    pop(depth)
                    break
        # A heading is called header for its looks; it goes with what it stands in.
        plain = tag in HEADINGS or not match.group(3)
        around, sure, inside = (False, False, False) if plain else _marks(match.group(3))
        marked = tag in ("article", "main")
        if marked and not around and any(e.out for e in stack):
            # An article is never inside its surroundings: they were left open.
            pop(next(i for i, e in enumerate(stack) if e.out))
        top = stack[-1]
        doubted = around and not sure and not marked and top.article >= 0
        around = around and not doubted
        out = top.out or tag in NEVER or (around and not marked and tag not in ("html", "body"))
        out = out or (marked and around) or (tag == "header" and top.article < 0)
        article = top.article
        if not out and (marked or (inside and tag in BLOCK and tag not in ("html", "body", *HEADINGS, "p"))):
            articles.append((tag if marked else "named", top.article))
            article = len(articles) - 1
        if match.group(3).endswith("/") and tag not in BLOCK:
            continue
        count += 1
        stack.append(Element(tag, out, article, top.link or tag == "a", top.doubted or doubted))
        parents.append(count if tag in BLOCK and tag not in ("p", *HEADINGS, "li") else parents[-1])
    for block in found:
        block.text = " ".join("".join(block.pieces).split())
    return [b for b in found if b.text], articles


def _close_implied(tag: str, stack: list[Element], pop) -> None:
    """A block ends an open paragraph; list items, cells and rows end their like."""
    alike = {
        "li": ({"li"}, {"ul", "ol", "menu"}),
        "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}),
    }
    ends, bounds = alike.get(tag, ({"p"} | (HEADINGS if tag in HEADINGS else set()), BLOCK - {"p"} - HEADINGS))
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in ends:
            pop(depth)
            return
        if stack[depth].tag in bounds:
            return


def _link_density(block: Block) -> float:
    return len(" ".join("".join(block.linked).split())) / len(block.text)


def _first_pass(block: Block, known_article: bool) -> str:
    """good, bad or short, from the block alone."""
    size = len(block.text)
    links = _link_density(block)
    words = _WORD.findall(block.text.lower())
    density = sum(word in STOP_WORDS for word in words) / max(len(words), 1)
    if known_article:
        # A link in running words is a sentence, whatever its length; a list of links has few stop words.
        if links > LINKS_INSIDE and density < FEW_STOP_WORDS:
            return "bad"
        return "short" if size < SHORT else "good"
    if links > LINKS_OUTSIDE or block.text.startswith("©"):
        return "bad"
    if size < SHORT:
        return "short"
    if density >= MANY_STOP_WORDS or (size >= LONG and density >= FEW_STOP_WORDS):
        return "good"
    return "bad" if size < LONG and density < FEW_STOP_WORDS / 2 else "near"


def _second_pass(blocks: list[Block], known_article: bool) -> None:
    """Undecided blocks take the label of their nearest decided neighbours."""
    decided = [i for i, b in enumerate(blocks) if b.label in ("good", "bad")]
    labels = {i: blocks[i].label for i in decided}
    before, after = [None] * len(blocks), [None] * len(blocks)
    last = None
    for i in range(len(blocks)):
        before[i] = last
        last = i if i in labels else last
    last = None
    for i in reversed(range(len(blocks))):
        after[i] = last
        last = i if i in labels else last
    for i, block in enumerate(blocks):
        if i in labels:
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        found = {labels[j] for j in near}
        if known_article and not block.doubted:
            # Only a heading between link lists is one of them.
            block.label = "bad" if block.heading and len(near) == 2 and found == {"bad"} else "good"
        elif len(found) == 1:
            block.label = found.pop()
        elif not near:
            # Nothing is decided anywhere on the page.
            block.label = "good" if block.label == "near" else "bad"
        else:
            # Neighbours differ: the one in the same element counts, then a heading looks ahead, then the nearer.
            same = [j for j in near if blocks[j].parent == block.parent]
            if len(same) == 1:
                block.label = labels[same[0]]
            elif block.heading:
                block.label = labels[near[1]]
            else:
                block.label = labels[min(near, key=lambda j: (abs(j - i), labels[j] == "bad"))]


def _without_good(blocks: list[Block]) -> None:
    """On an unmarked page without a good block, what is no link list counts from the main heading on."""
    start = next((i for i, b in enumerate(blocks) if b.heading == "h1"), 0)
    for block in blocks[start:]:
        if _link_density(block) <= LINKS_OUTSIDE and not block.text.startswith("©"):
            block.label = "good"


def _around(at: int, articles: list[tuple[str, int]]) -> Iterator[int]:
    """A marked article and those around it."""
    while at >= 0:
        yield at
        at = articles[at][1]


def _body(blocks: list[Block], articles: list[tuple[str, int]]) -> list[Block] | None:
    """The blocks of the marked article that holds most text: article before main before class names.

    An article inside another one is a comment on it and counts for itself. Of named
    elements within each other, the inner one is taken if it has nearly all; a main
    heading before it, in what is marked around it, belongs to it.
    """
    owner = [next((a for a in _around(b.article, articles) if articles[a][0] == "article"), -1) for b in blocks]
    sizes = [0] * len(articles)
    for block, own in zip(blocks, owner):
        for at in _around(block.article, articles):
            if articles[at][0] != "article" or at == own:
                sizes[at] += len(block.text)
    for kind in ("article", "main", "named"):
        found = [a for a, (k, _) in enumerate(articles) if k == kind and sizes[a]]
        if not found:
            continue
        most = max(sizes[a] for a in found)
        chosen = max(a for a in found if sizes[a] >= (0.9 if kind == "named" else 1) * most)
        outer = set(_around(chosen, articles)) - {chosen}
        body = []
        for block, own in zip(blocks, owner):
            if own == chosen if kind == "article" else chosen in _around(block.article, articles):
                body.append(block)
            elif block.heading == "h1" and block.article in outer and not body:
                body.append(block)
        return body
    return None


def extract(page: str | None) -> str:
    """The main text of a page: its blocks joined by one line feed; empty if there is none."""
    found, articles = blocks_of(page or "")
    usable = [b for b in found if not b.out]
    body = _body(usable, articles)
    blocks = usable if body is None else body
    for block in blocks:
        block.label = _first_pass(block, body is not None and not block.doubted)
    _second_pass(blocks, body is not None)
    if body is None and not any(b.label == "good" for b in blocks):
        _without_good(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def main_text(pages: DataFrame, carry: list[str], html_col: str = "html", name: str = "text") -> DataFrame:
    """The carried columns and the main text of each page, from its whole html.

    NULL, empty and text-free pages have empty text; markup that is cut off or nested
    wrongly is read as far as it goes, unknown elements count as inline, and a page of
    any length is read in one go. Each row is read by itself, so repeated rows get
    the same text. A carried column with the result's name is replaced.
    """
    carried = [c for c in carry if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_html"):
            texts = [extract(page) for page in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in carried] + [pa.array(texts, pa.string())], names=[*carried, name]
            )

    rows = pages.select(*[column(c) for c in carried], column(html_col).alias("_html"))
    schema = T.StructType([rows.schema[c] for c in carried]).add(name, T.StringType())
    return rows.mapInArrow(run, schema)

"""Main text of web pages: flat text blocks, classified by a decision tree over words, links and neighbours.

A page is cut into flat blocks at block-level tags. A block's features are its words and link density,
those of the blocks before and after it, and where it stands: in the page's main element, in an element
whose tag or names tell of a menu, notice, advert, form or comments, in a heading. Names are evidence, no
verdict: how sure they are and how far up the element stands are features, and names of an element that stands
round the page's main element or holds most of its words tell nothing. A decision tree, grown on a
small labelled table of blocks, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map

#: Fixed by the HTML standard: elements whose content is no markup, elements that never hold content.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not break a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text, those that may be, and those that hold it.
ASIDE = set("nav aside footer button select option datalist dialog menu noscript template svg canvas object audio video map head".split())
MAYBE = {"form", "fieldset", "header"}
MAIN = {"article", "main"}
#: Words in class, id, role or label that tell of something else than main text, and words beside them that change nothing.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices alert sidebar side rail nav navbar navigation menu menus breadcrumb breadcrumbs crumbs footer foot masthead topbar toolbar share sharing social related recommended comment comments reply replies respond disqus newsletter subscribe subscription signup login popup modal overlay widget pagination pager paywall complementary contentinfo search hidden copyright tags skip".split()
)
NEUTRAL = frozenset("list box block area section wrap wrapper container inner outer item items row col column bar panel group holder content link links post posts site page top bottom left right global text title icon icons button buttons btn form thread body slot js and the of".split())
#: A name that begins so tells of what is there or not, not of what the element is.
ABOUT = {"has", "no", "not", "with", "without", "is"}
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])")
TOKEN = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|$))|([!?])[^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$))", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: An open p ends where one of these begins.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@lru_cache(maxsize=4096)
def hint(names: str) -> int:
    """How surely names tell of something else than main text: 2 if one has words for it alone, 1 if it has others too, else 0."""
    best = 0
    for name in re.split(r"[\s]+", names):
        parts = [x for x in re.split(r"[_-]+", name) if x]
        if parts and parts[0] not in ABOUT and any(x in HINTS for x in parts):
            best = max(best, 2 if all(x in HINTS or x in NEUTRAL or x.isdigit() for x in parts) else 1)
    return best


#: A hint is passed over where the element that gives it holds so much of the page's words, by how sure it is.
MOST = {0: 0.0, 1: 0.3, 2: 0.95}


class Mark:
    """An element that tells of its text: by its tag (never main text), or by names (hint)."""

    __slots__ = ("depth", "hint", "never", "round_main", "share", "up", "words")

    def __init__(self, up: int, depth: int, never: bool, hint: int):
        self.up, self.depth, self.never, self.hint, self.words, self.share, self.round_main = up, depth, never, hint, 0, 0.0, False


class Block:
    __slots__ = ("depth", "far", "heading", "hint", "link_words", "main", "mark", "never", "root", "text", "words")

    def __init__(self, text: str, words: int, link_words: int, never: bool, hint: int, far: int, main: bool, heading: bool):
        self.text, self.words, self.link_words, self.never, self.hint, self.far, self.main, self.heading = text, words, link_words, never, hint, far, main, heading
        self.depth, self.mark, self.root = 0, -1, -1


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks in page order: character references decoded, white space one space, trimmed, empty ones left out.

    Time grows with the length of the page, however deep its elements nest.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, innermost mark, innermost main element, whether in one
    places: dict[str, list[int]] = {}  # where each tag stands in the stack
    marks: list[Mark] = []
    roots: list[list[int]] = []  # of each main element: words, mark round it, whether it is <main>, the one round it
    pieces: list[tuple[str, bool]] = []
    heading, at, size = False, 0, len(page)

    def inside() -> tuple[int, int, bool]:
        return stack[-1][1:] if stack else (-1, -1, False)

    def linked() -> bool:
        return bool(places.get("a"))

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                words = text.count(" ") + 1
                b = Block(text, words, min(sum(len(p.split()) for p, x in pieces if x), words), False, 0, 0, inside()[2], heading)
                b.depth, b.mark, b.root = len(stack), inside()[0], inside()[1]
                out.append(b)
            pieces.clear()

    def leave(tag: str) -> None:
        """Close the innermost element of that tag with those inside it; an end tag without a start is passed over."""
        if not places.get(tag):
            return
        k = places[tag][-1]
        if tag not in ("table", "body", "html") and any(places.get(t) and places[t][-1] > k for t in ("table", "body")):
            return
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    while at < size:
        start = page.find("<", at)
        if start < 0:
            pieces.append((page[at:], linked()))
            break
        if start > at:
            pieces.append((page[at:start], linked()))
        m = TOKEN.match(page, start)
        if not m:
            if page.startswith("</", start) and start + 2 < size:  # a bogus comment
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                pieces.append(("<", linked()))
                at = start + 1
            continue
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag not in INLINE:
                close()
            elif tag == "br":
                pieces.append((" ", False))
            leave(tag)
            heading = heading and not re.fullmatch("h[1-6]", tag)
            continue
        if tag in RAW:
            close() if tag not in ("script", "style") else None
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            over = page.find(">", end.end()) if end else -1
            at = over + 1 if over >= 0 else size
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag not in INLINE:
            close()
        if tag in VOID:
            continue
        if tag in ENDS_P and places.get("p"):
            leave("p")
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            leave(tag)
        mark, root, main = inside()
        attributes = m[4] or ""
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        names = " ".join(x.lower() for found in NAMED.findall(attributes) for x in found if x) if attributes else ""
        if tag not in ("html", "body"):
            never = tag in ASIDE or bool(attributes and HIDDEN.search(attributes))
            sure = int(tag in MAYBE and not (tag == "header" and main))
            if names and tag not in MAIN:
                sure = max(sure, hint(names), 2 if not main and HEADER.search(names) else 0)
            if never or sure:
                marks.append(Mark(mark, len(stack), never, sure))
                mark = len(marks) - 1
        if tag in MAIN or "main" in names.split():
            roots.append([0, mark, int(tag != "article"), root])
            root, main = len(roots) - 1, True
        heading = heading or bool(re.fullmatch("h[1-6]", tag))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, mark, root, main))
    close()
    _weigh(out, marks, roots)
    return out


def _weigh(found: list[Block], marks: list[Mark], roots: list[list[int]]) -> None:
    """Set what the marks round each block tell, but for those round the page's main element."""
    total = sum(b.words for b in found) or 1
    for b in found:
        if b.mark >= 0:
            marks[b.mark].words += b.words
        if b.root >= 0:
            roots[b.root][0] += b.words
    for mark in reversed(marks):
        if mark.up >= 0:
            marks[mark.up].words += mark.words
    for root in reversed(roots):
        if root[3] >= 0:
            roots[root[3]][0] += root[0]
    never, sure = [False] * len(marks), [0] * len(marks)
    for k, mark in enumerate(marks):
        never[k] = mark.never or mark.up >= 0 and never[mark.up]
        sure[k] = max(mark.hint, sure[mark.up] if mark.up >= 0 else 0)
    # The page's main element: <main> before <article>; an article among things that are named otherwise must hold much of the page.
    best = None
    for words, mark, is_main, _ in roots:
        if words and (is_main or mark < 0 or not never[mark] and (sure[mark] < 2 or words >= 0.4 * total)):
            best = max(best or (0, 0, -1), (is_main, words, mark))
    at = best[2] if best else -1
    while at >= 0:
        marks[at].round_main = True
        at = marks[at].up
    told: list[tuple[bool, int, int]] = []  # of each mark: never main text; the surest and outermost hint; where it stands
    for mark in marks:
        mark.share = mark.words / total
    for k, mark in enumerate(marks):
        never_up, hint_up, which = told[mark.up] if mark.up >= 0 else (False, 0, -1)
        if not mark.round_main:
            never_up = never_up or mark.never
            if mark.hint > hint_up and mark.share < MOST[mark.hint]:
                hint_up, which = mark.hint, k
        told.append((never_up, hint_up, which))
    for b in found:
        if b.mark >= 0:
            b.never, b.hint, which = told[b.mark]
            if which >= 0:
                b.far = b.depth - marks[which].depth


def vectors(found: list[Block]) -> np.ndarray:
    """A row of features for each block: its words and link density, those of the blocks before and after, and where it stands."""
    if not found:
        return np.zeros((0, 12))
    words = np.array([b.words for b in found], float)
    density = np.array([b.link_words / b.words for b in found])
    has_main = float(any(b.main and not b.never and b.hint < 2 for b in found))
    near = lambda x, k: np.r_[x[1:], 0.0] if k > 0 else np.r_[0.0, x[:-1]]
    flags = np.array([[b.heading, b.never, b.hint, b.far, b.main] for b in found], float)
    return np.column_stack([words, density, near(words, -1), near(density, -1), near(words, 1), near(density, 1), flags, np.full(len(found), has_main)])



#: Blocks of more words than this have no length of their own in the labelled table.
LONGER = 20

#: The labelled table, a row for each block of invented pages, in page order: words, words in links, in an element
#: that is never main text, how sure a hint is, percent of the page's words in the hinting element, how far up it
#: stands, main element, heading, main text.
LABELLED = (
    # with a main element, menus and a footer
    ((2, 2, 1, 0, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0, 0, 0), (9, 0, 0, 2, 7, 1, 0, 0, 0), (7, 0, 0, 0, 0, 0, 1, 1, 1), (60, 0, 0, 0, 0, 0, 1, 0, 1), (1, 0, 0, 0, 0, 0, 1, 0, 1), (35, 2, 0, 0, 0, 0, 1, 0, 1), (4, 0, 1, 0, 0, 0, 0, 0, 0)),
    ((40, 0, 0, 2, 20, 1, 0, 0, 0), (3, 0, 0, 0, 0, 0, 1, 1, 1), (5, 0, 0, 0, 0, 0, 1, 0, 1), (2, 2, 0, 0, 0, 0, 1, 0, 1), (80, 6, 0, 0, 0, 0, 1, 0, 1), (12, 0, 1, 0, 0, 0, 1, 0, 0), (30, 0, 0, 2, 15, 2, 1, 0, 0), (25, 0, 0, 0, 0, 0, 0, 0, 0)),
    ((6, 6, 0, 0, 0, 0, 0, 0, 0), (12, 0, 0, 0, 0, 0, 1, 1, 1), (9, 9, 0, 0, 0, 0, 1, 0, 1), (18, 0, 0, 0, 0, 0, 1, 0, 1), (3, 3, 0, 0, 0, 0, 0, 0, 0), (70, 0, 0, 2, 60, 1, 0, 0, 0)),
    ((2, 2, 1, 0, 0, 0, 0, 0, 0), (6, 0, 1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 1, 1, 1), (2, 0, 0, 0, 0, 0, 1, 0, 1), (1, 0, 0, 0, 0, 0, 1, 0, 1), (3, 0, 0, 0, 0, 0, 1, 0, 1), (1, 0, 0, 0, 0, 0, 1, 0, 1), (9, 0, 0, 2, 30, 1, 0, 0, 0)),
    ((1, 1, 1, 0, 0, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0, 1, 1, 1), (90, 0, 0, 0, 0, 0, 1, 0, 1), (2, 0, 0, 0, 0, 0, 1, 0, 1), (2, 1, 0, 0, 0, 0, 1, 0, 1), (1, 0, 0, 0, 0, 0, 1, 0, 1)),
    ((5, 0, 0, 0, 0, 0, 0, 0, 0), (30, 0, 0, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0, 1, 0), (1, 0, 0, 0, 0, 0, 1, 0, 1), (140, 0, 0, 0, 0, 0, 1, 0, 1), (1, 1, 0, 0, 0, 0, 1, 0, 1), (2, 0, 0, 0, 0, 0, 1, 0, 1), (24, 0, 0, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0)),
    # comments that hold most of the page, in the main element and after it
    ((1, 0, 0, 0, 0, 0, 1, 1, 1), (20, 0, 0, 0, 0, 0, 1, 0, 1), (60, 0, 0, 2, 92, 2, 1, 0, 0), (200, 0, 0, 2, 92, 3, 1, 0, 0), (2, 0, 0, 2, 92, 2, 1, 0, 0), (1, 0, 0, 0, 0, 0, 1, 0, 1)),
    ((5, 0, 0, 0, 0, 0, 1, 1, 1), (26, 0, 0, 0, 0, 0, 1, 0, 1), (80, 0, 0, 2, 90, 1, 0, 0, 0), (150, 2, 0, 2, 90, 1, 0, 0, 0)),
    # names that have words beside the hint: in the main element they say little of long text
    ((6, 0, 0, 1, 70, 1, 1, 1, 1), (48, 0, 0, 1, 70, 1, 1, 0, 1), (3, 0, 0, 1, 70, 1, 1, 0, 1), (36, 2, 0, 1, 70, 2, 1, 0, 1), (7, 7, 0, 2, 4, 1, 1, 0, 0)),
    ((4, 0, 0, 0, 0, 0, 1, 1, 1), (50, 0, 0, 0, 0, 0, 1, 0, 1), (44, 0, 0, 1, 35, 1, 1, 0, 1), (30, 1, 0, 1, 35, 1, 1, 0, 1), (6, 5, 0, 1, 5, 1, 1, 0, 0), (8, 8, 0, 1, 6, 1, 1, 0, 0)),
    ((5, 0, 0, 0, 0, 0, 1, 1, 1), (70, 1, 0, 0, 0, 0, 1, 0, 1), (14, 0, 0, 1, 12, 1, 1, 0, 0), (2, 0, 0, 1, 12, 1, 1, 0, 0), (1, 0, 0, 1, 12, 1, 1, 0, 0), (55, 0, 0, 0, 0, 0, 1, 0, 1), (32, 0, 0, 1, 13, 1, 1, 0, 1)),
    ((3, 0, 0, 1, 6, 1, 0, 1, 0), (8, 0, 0, 1, 6, 1, 0, 0, 0), (2, 0, 0, 0, 0, 0, 1, 1, 1), (24, 0, 0, 1, 90, 1, 1, 0, 1), (41, 0, 0, 1, 90, 1, 1, 0, 1)),
    # without a main element
    ((1, 1, 0, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0, 0, 0), (8, 0, 0, 0, 0, 0, 0, 1, 1), (55, 1, 0, 0, 0, 0, 0, 0, 1), (48, 0, 0, 0, 0, 0, 0, 0, 1), (14, 0, 0, 0, 0, 0, 0, 0, 1), (90, 4, 0, 0, 0, 0, 0, 0, 1), (3, 2, 0, 0, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0, 0, 0)),
    ((3, 3, 0, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0, 0, 1, 1), (30, 0, 0, 0, 0, 0, 0, 0, 1), (22, 3, 0, 0, 0, 0, 0, 0, 1), (40, 0, 0, 2, 30, 1, 0, 0, 0), (33, 0, 0, 0, 0, 0, 0, 0, 1), (4, 4, 0, 0, 0, 0, 0, 0, 0)),
    ((25, 0, 0, 2, 20, 1, 0, 0, 0), (5, 0, 0, 0, 0, 0, 0, 1, 1), (16, 0, 0, 0, 0, 0, 0, 0, 1), (11, 0, 0, 0, 0, 0, 0, 0, 1), (45, 0, 0, 0, 0, 0, 0, 0, 1), (9, 8, 0, 0, 0, 0, 0, 0, 0), (7, 7, 0, 0, 0, 0, 0, 0, 0), (15, 14, 0, 0, 0, 0, 0, 0, 0)),
    ((1, 0, 0, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0, 0, 0), (50, 0, 0, 0, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 0, 0, 0, 1), (65, 5, 0, 0, 0, 0, 0, 0, 1), (20, 18, 0, 0, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0, 0, 0), (60, 0, 1, 0, 0, 0, 0, 0, 0)),
    ((5, 0, 0, 0, 0, 0, 0, 1, 1), (40, 0, 0, 0, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 0, 0, 0, 1), (1, 0, 0, 0, 0, 0, 0, 0, 1), (6, 0, 1, 0, 0, 0, 0, 0, 0)),
    ((4, 0, 0, 0, 0, 0, 0, 1, 1), (28, 0, 0, 0, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 0, 0, 0, 1), (38, 2, 0, 0, 0, 0, 0, 0, 1), (10, 10, 0, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0, 0, 0), (6, 0, 0, 2, 6, 1, 0, 0, 0)),
    ((2, 2, 0, 0, 0, 0, 0, 0, 0), (40, 0, 0, 0, 0, 0, 0, 0, 1), (42, 0, 0, 0, 0, 0, 0, 0, 1), (2, 2, 0, 0, 0, 0, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0, 0, 0, 0), (33, 0, 0, 0, 0, 0, 0, 0, 1), (1, 1, 0, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0, 0, 0)),
    ((2, 2, 0, 0, 0, 0, 0, 0, 0), (9, 0, 0, 0, 0, 0, 0, 1, 1), (27, 1, 0, 0, 0, 0, 0, 0, 1), (2, 2, 0, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0, 0, 0)),
    # pages of little text
    ((6, 0, 0, 0, 0, 0, 0, 0, 1),),
    ((12, 0, 0, 0, 0, 0, 0, 0, 1),),
    ((9, 0, 0, 0, 0, 0, 0, 0, 1), (8, 1, 0, 0, 0, 0, 0, 0, 1)),
    ((3, 0, 0, 0, 0, 0, 0, 1, 1), (7, 0, 0, 0, 0, 0, 0, 0, 1)),
    # a form or a name round most of the page
    ((2, 2, 1, 1, 96, 2, 0, 0, 0), (6, 0, 0, 1, 96, 1, 0, 1, 1), (52, 1, 0, 1, 96, 2, 0, 0, 1), (34, 0, 0, 1, 96, 2, 0, 0, 1), (3, 3, 0, 1, 96, 2, 0, 0, 0), (5, 4, 0, 1, 96, 2, 0, 0, 0), (4, 0, 1, 1, 96, 2, 0, 0, 0)),
    ((5, 0, 0, 2, 98, 1, 0, 1, 1), (44, 1, 0, 2, 98, 2, 0, 0, 1), (37, 0, 0, 2, 98, 2, 0, 0, 1), (4, 0, 1, 2, 98, 2, 0, 0, 0), (30, 0, 1, 2, 98, 2, 0, 0, 0), (2, 2, 0, 2, 98, 2, 0, 0, 0)),
    ((3, 0, 0, 1, 9, 1, 0, 1, 0), (9, 0, 0, 1, 9, 1, 0, 0, 0), (2, 2, 1, 1, 9, 2, 0, 0, 0), (50, 1, 0, 1, 45, 1, 0, 0, 1), (22, 0, 0, 1, 45, 1, 0, 0, 1), (60, 0, 0, 2, 46, 1, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0, 0, 0, 0), (5, 0, 0, 1, 88, 1, 0, 1, 1), (62, 0, 0, 1, 88, 1, 0, 0, 1), (31, 0, 0, 1, 88, 1, 0, 0, 1), (4, 4, 0, 0, 0, 0, 0, 0, 0)),
    ((3, 3, 0, 1, 97, 2, 0, 0, 0), (41, 0, 0, 1, 97, 2, 0, 0, 1), (57, 2, 0, 1, 97, 3, 0, 0, 1), (6, 6, 0, 1, 97, 2, 0, 0, 0), (28, 0, 0, 2, 14, 1, 0, 0, 0)),
    # names on little of the page
    ((46, 0, 0, 0, 0, 0, 0, 0, 1), (38, 0, 0, 1, 25, 1, 0, 0, 1), (51, 3, 0, 0, 0, 0, 0, 0, 1), (8, 6, 0, 1, 5, 1, 0, 0, 0), (6, 0, 0, 1, 4, 1, 0, 0, 0), (35, 0, 0, 2, 55, 1, 0, 0, 0), (90, 1, 0, 2, 55, 2, 0, 0, 0)),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 4):
    """A decision tree as nested (feature, limit, below, above) and, at its leaves, the share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < limit
            if least <= low.sum() <= len(y) - least:
                gini = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, float(limit), low)
    if best is None:
        return share
    _, f, limit, low = best
    return f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of LABELLED, each page in several lengths of its longer blocks, so that no split hangs on one count."""
    x, y = [], []
    for scale in (0.5, 0.7, 1.0, 1.6, 3.0):
        for page in LABELLED:
            found = []
            for w, k, never, sure, share, far, main, heading, _ in page:
                words = round(LONGER + (w - LONGER) * scale) if w > LONGER else w
                found.append(Block("", words, round(words * k / w), bool(never), *(sure, far) if share < 100 * MOST[sure] else (0, 0), bool(main), bool(heading)))
            x.append(vectors(found))
            y += [r[-1] for r in page]
    return np.concatenate(x), np.array(y, float)


@cache
def tree():
    """The tree grown on LABELLED."""
    return grow(*labelled())


def classified(x: np.ndarray, by=None) -> np.ndarray:
    """Whether each row of features is main text, by a tree or else that of LABELLED."""
    out = np.zeros(len(x), bool)

    def walk(node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, float):
            out[rows] = node >= 0.5
            return
        f, limit, below, above = node
        low = x[rows, f] < limit
        walk(below, rows[low])
        walk(above, rows[~low])

    walk(tree() if by is None else by, np.arange(len(x)))
    return out


def main_text(page: str | None) -> str:
    """Main text of a page, its blocks joined by one space; empty if it has none."""
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, good in zip(found, classified(vectors(found)), strict=True) if good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages, and those without main text, give an empty text. Null ids, repeated rows and an
    empty table pass through; other columns are ignored; a page of any length is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return arrow_map(rows, run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

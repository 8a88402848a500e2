"""HTML to a small tree of sections and text blocks, as arrays over many pages.

The tree holds an element for each tag that starts a block (inline tags are dissolved) and a leaf for each run of text between two such
tags. Head, scripts, styles and form controls hold no text. Tags left open are closed as a browser would: a paragraph by the next
block, a list item by the next item, all else by the end of what encloses it. Elements nested deeper than DEPTH are attached there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

DEPTH = 400
#: A tag, comment or declaration. Quotes count only after "="; nothing backtracks, so odd markup costs linear time.
_MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|data-main)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = ".,;:!?"

#: Tags whose content is no text of the page.
SILENT = frozenset("head script style noscript template iframe svg math object audio video canvas select button textarea datalist title".split())
#: Of these, those whose content is not parsed.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stay inside a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr picture map area link meta base param source track embed col".split()
)
#: Groups of block tags; the first names the group. Other tags are "other".
GROUPS = (
    "body html", "article", "main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li dt dd", "table tbody thead tfoot tr caption", "td th",
    "nav", "header", "footer address", "aside", "form fieldset legend dialog", "blockquote pre figure figcaption", "details summary", "hr",
)
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
OTHER, LEAF = len(GROUPS), len(GROUPS) + 1
#: Words of class, id and role by what they tell.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager toc topics links skip",
    "header": "header masthead banner logo topbar branding brand hero top",
    "footer": "footer foot colophon copyright legal bottom contentinfo",
    "side": "sidebar side aside rail widget complementary column secondary",
    "related": "related recommended recommendations more popular trending teaser teasers next previous tags",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted commercial dfp adsense",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay warning disclaimer privacy paywall announcement",
    "form": "form search login signin signup register subscribe subscription newsletter contact poll survey",
    "comment": "comment comments commentlist reply replies disqus discussion respond feedback reader readers thread",
    "share": "share sharing social follow facebook twitter",
    "main": "content article post entry story body main text page prose",
    "meta": "meta byline author date published time caption",
}
_TELLS = {w: i for i, k in enumerate(NAMES) for w in NAMES[k].split()}
HIDDEN = len(NAMES)


@dataclass
class Forest:
    """Trees of many pages. Nodes stand in page order, parents first; roots have parent -1."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    #: Bits of what class, id and role tell.
    tells: list[int] = field(default_factory=list)
    #: Of leaves: the text, its words, marks, whether it ends a sentence, and its characters inside links.
    text: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)
    #: 1 inside an element marked data-main="1", 0 elsewhere: labels of pages made for training.
    label: list[int] = field(default_factory=list)

    def node(self, page: int, parent: int, group: int, tells: int, label: int, text: str = "", linked: float = 0.0) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.group.append(group)
        self.tells.append(tells)
        self.label.append(label)
        self.text.append(text)
        self.words.append(text.count(" ") + 1 if text else 0)
        self.marks.append(sum(map(text.count, _MARKS)) if text else 0)
        self.ends.append(text[-1:] in ".!?…:\"'”»" if text else 0)
        self.linked.append(linked)
        return len(self.page) - 1

    def array(self, name: str) -> np.ndarray:
        return np.array(getattr(self, name), np.float64 if name == "linked" else np.int64)


def _tells(attributes: str) -> tuple[int, int | None]:
    """Bits of what class, id, role and style tell; the label, if one is given."""
    bits, label = 0, None
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "data-main":
            label = int(value == "1")
        elif name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or value.lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                bits |= 1 << HIDDEN
        else:
            for w in _WORD.findall(value):
                k = _TELLS.get(w.lower())
                if k is not None:
                    bits |= 1 << k
    return bits, label


#: What an opening tag closes, up to the tags that hold it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}


def parse(source: str, page: int, forest: Forest) -> None:
    """Adds the tree of one page."""
    root = forest.node(page, -1, GROUP["body"], 0, 0)
    stack: list[tuple[str, int]] = [("html", root)]
    buffer: list[str] = []
    links, linked, silent, at = 0, 0, "", 0
    held: Counter = Counter()  # open tags

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        if text:
            top = stack[-1][1]
            forest.node(page, top, LEAF, 0, forest.label[top], text, min(1.0, linked / max(1, len(text))))
        buffer.clear()
        linked = 0

    def pop(k: int) -> None:
        flush()
        held.subtract(t for t, _ in stack[k:])
        del stack[k:]

    def innermost(tag: str) -> int:
        """Place of the innermost open tag of that name, 0 if there is none."""
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag) if held[tag] > 0 else 0

    while at < len(source):
        m = _MARKUP.search(source, at)
        if not silent:
            piece = source[at : m.start() if m else len(source)]
            if piece:
                buffer.append(piece)
                if links:
                    linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if silent:  # up to its end, whatever stands inside
            if m[1] and tag == silent:
                silent = ""
            continue
        if m[1]:
            if tag == "a":
                links = 0
            if tag in INLINE or tag in SILENT:
                continue
            if k := innermost(tag):
                pop(k)
                links = 0
            elif tag != "p":
                flush()
            continue
        if tag in RAW or tag in SILENT:
            if m[3].rstrip().endswith("/") and tag not in RAW:
                continue
            if tag not in ("select", "button", "svg", "math"):
                flush()
            if tag in RAW:  # its end is looked for as text
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag == "head":  # ends with its tag or where the body starts
                end = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(source, at)
                at = end.end() if end else at
            else:
                silent = tag
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in ("html", "body"):
            flush()
            continue
        flush()
        links = 0
        if k := innermost("p"):
            pop(k)
        if tag in _CLOSES:
            closed, holders = _CLOSES[tag]
            k, first = len(stack) - 1, 0
            while k > 0 and stack[k][0] not in holders:
                if stack[k][0] in closed:
                    first = k
                k -= 1
            if first:
                pop(first)
        bits, label = _tells(m[3]) if m[3] else (0, None)
        top = stack[-1][1]
        node = forest.node(page, top, GROUP.get(tag, OTHER), bits, forest.label[top] if label is None else label)
        if tag not in VOID and not (m[3].endswith("/") and tag not in GROUP) and len(stack) < DEPTH:
            stack.append((tag, node))
            held[tag] += 1
    flush()


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, from the roots down."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


#: Upper bounds of bins.
_WORDS, _SHARES, _LINKS, _PLACES = (1, 2, 4, 8, 16, 40), (0.02, 0.1, 0.3, 0.6, 0.9), (0.0, 0.3, 0.7), (0.05, 0.3, 0.7, 0.95)


def _bins(values: np.ndarray, bounds: tuple) -> np.ndarray:
    """One column a bin."""
    return np.eye(len(bounds) + 1)[np.searchsorted(bounds, values, "left")]


def features(forest: Forest) -> np.ndarray:
    """A row of numbers for each node: tag group, names, length, links, punctuation, place and share of the page."""
    parent, group, words, tells = (forest.array(c) for c in ("parent", "group", "words", "tells"))
    leaf = group == LEAF
    sums = np.stack([words, forest.array("linked") * words, forest.array("marks"), leaf, leaf & (words <= 3)], 1).astype(float)
    page, down = forest.array("page"), levels(forest.array("depth"))
    before = np.cumsum(words) - words
    total = np.bincount(page, words, page.max(initial=0) + 1) if len(page) else np.zeros(0)
    roots = np.flatnonzero(parent < 0)
    start = np.zeros(len(total))
    start[page[roots]] = before[roots]
    for level in reversed(down[1:]):
        np.add.at(sums, parent[level], sums[level])
    whole = np.maximum(1, total[page])
    n, links, marks, leaves, short = sums.T
    some, one = np.maximum(1, n), np.maximum(1, leaves)
    up = np.where(parent >= 0, group[parent], OTHER)
    own = np.where(leaf, up, group)  # a leaf speaks by its element's tag
    kinds, ups = np.eye(LEAF + 1)[own], np.eye(LEAF + 1)[up]
    told = (tells[:, None] >> np.arange(HIDDEN + 1) & 1).astype(float)
    numbers = [_bins(n / one, _WORDS), _bins(links / some, _LINKS), _bins(marks / some, (0.0, 0.05, 0.15)), _bins((before - start[page]) / whole, _PLACES), _bins(n / whole, _SHARES), _bins(leaves, (0, 1, 3, 8)), _bins(short / one, (0.0, 0.3, 0.7))]
    numbers = np.concatenate([*numbers, forest.array("ends")[:, None]], 1)
    return np.concatenate([np.ones((len(n), 1)), leaf[:, None], kinds * leaf[:, None], kinds * ~leaf[:, None], ups * ~leaf[:, None], told, numbers * leaf[:, None], numbers * ~leaf[:, None]], 1).astype(np.float32)

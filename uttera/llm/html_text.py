"""Main text of web pages by a tree-structured graphical model over their DOM.

* Each page is a tree (html_tree) whose nodes, elements and text blocks, have a hidden state: around the main text, part of it, or other. Every edge from parent to child has
  a potential, a 3 x 3 table that is linear in the features of the child (its own, and its parent's tag). Sum-product messages, upward from the leaves and then downward
  from the root, give exact marginals; a block is kept if its marginal of being part is at least 0.5. Pages of a batch pass their messages level by level together.
* The weights are trained by maximum likelihood (the gradient is observed less expected edge counts, from the same messages) on labelled pages of two kinds: at most PAGES pages of the table
  that label themselves by an article or main element, once as they are and once with these elements and all names hidden, and LAYOUTS pages laid out by the rules below around
  words of such pages, for what the table's pages may lack: sidebars, notices, forms, reader comments, unnamed containers.
* Only these pages meet on the driver, PAGES of at most LONGEST characters each; all other work is by Spark tasks, page by page.

Defined cases: null and blank pages have an empty text. Pages cut off anywhere are read to their end. Repeated rows give repeated rows. Without labelled
pages the model learns from the layouts alone. An empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import small_batches, tidy
from uttera.llm.html_tree import LEAF, Forest, features, levels, parse

#: Training pages of the table, their greatest length, laid-out pages, steps, rate and the weight of squared weights.
PAGES, LONGEST, LAYOUTS, STEPS, RATE, RIDGE = 150, 200_000, 700, 160, 0.15, 0.01
KEEP = 0.5
#: States.
AROUND, MAIN, BESIDE = range(3)
STATES = 3


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum of exponentials over a short axis, slice by slice."""
    parts = np.moveaxis(x, axis, 0)
    out = parts[0]
    for p in parts[1:]:
        out = np.logaddexp(out, p)
    return out


def marginals(potentials: np.ndarray, parent: np.ndarray, down: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each node the log marginals of its states (n x k) and of its edge's (n x k x k, parent's state first), and the log partition sum.

    potentials: n x k x k in logs. Above a root stands a node that is in state 0.
    """
    n, k = potentials.shape[:2]
    below, message = np.zeros((n, k)), np.zeros((n, k))
    for level in reversed(down):  # upward
        message[level] = _log_sum(potentials[level] + below[level][:, None, :], 2)
        if level is not down[0]:
            below += np.stack([np.bincount(parent[level], message[level, j], n) for j in range(k)], 1)
    above, edge = np.zeros((n, k)), np.zeros((n, k, k))
    for level in down:  # downward
        if level is down[0]:
            over = np.tile([0.0] + [-np.inf] * (k - 1), (len(level), 1))
        else:
            p = parent[level]
            over = above[p] + below[p] - message[level]
            over = over - over.max(1, keepdims=True)
        e = over[:, :, None] + potentials[level] + below[level][:, None, :]
        above[level] = _log_sum(over[:, :, None] + potentials[level], 1)
        edge[level] = e - _log_sum(e.reshape(len(level), k * k), 1)[:, None, None]
    node = _log_sum(edge, 1) if n else np.zeros((0, k))
    return node, edge, float(message[down[0], 0].sum()) if down else 0.0


@dataclass(frozen=True)
class Model:
    """Weights of the edge potentials: a row a feature, a column for each pair of states."""

    weights: np.ndarray

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights).reshape(-1, STATES, STATES)

    def kept(self, forest: Forest) -> np.ndarray:
        """Marginal of being main text for each node."""
        if not forest.page:
            return np.zeros(0)
        return np.exp(marginals(self.potentials(features(forest)), forest.array("parent"), levels(forest.array("depth")))[0][:, MAIN])

    def texts(self, pages: list[str]) -> list[str]:
        forest = Forest()
        for i, source in enumerate(pages):
            parse(source, i, forest)
        out: list[list[str]] = [[] for _ in pages]
        p = self.kept(forest)
        for i in np.flatnonzero((p >= KEEP) & (forest.array("group") == LEAF)):
            out[forest.page[i]].append(forest.text[i])
        return ["\n".join(t) for t in out]


def states(forest: Forest) -> np.ndarray:
    """States of labelled pages: what stands in an element with data-main="1" is main text, less what stands in one with "0"."""
    main, parent = forest.array("label"), forest.array("parent")
    holds = main.copy()
    for level in reversed(levels(forest.array("depth"))[1:]):
        np.maximum.at(holds, parent[level], holds[level])
    return np.where(main == 1, MAIN, np.where(holds == 1, AROUND, BESIDE))


def trained(pages: list[str], steps: int = STEPS) -> Model:
    """The model of labelled pages."""
    forest = Forest()
    for i, source in enumerate(pages):
        parse(source, i, forest)
    x, parent, y = features(forest), forest.array("parent"), states(forest)
    down = levels(forest.array("depth"))
    seen = np.zeros((len(y), STATES * STATES))
    seen[np.arange(len(y)), STATES * np.where(parent >= 0, y[parent], AROUND) + y] = 1
    observed, n = x.T @ seen.astype(np.float32), max(1, len(pages))
    w, m, v = np.zeros((x.shape[1], STATES * STATES)), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam
        potentials = (x @ w.astype(np.float32)).astype(np.float64).reshape(-1, STATES, STATES)
        expected = x.T @ np.exp(marginals(potentials, parent, down)[1]).reshape(-1, STATES * STATES).astype(np.float32)
        g = (observed - expected) / n - RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + RATE * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(w)


# ---- labelled pages -------------------------------------------------------------------------------------------

_ARTICLE = re.compile(r"<(article|main)\b([^>]*)>", re.I)


def labelled(source: str) -> list[str]:
    """A page that names its article, twice: with the article marked, and with all names hidden as well."""
    if source.lower().count("<article") > 1:  # a list of teasers
        return []
    seen = [False]

    def mark(m: re.Match) -> str:
        first, seen[0] = not seen[0], True
        return f'<{m[1]}{m[2]} data-main="1">' if first else m[0]

    marked = _ARTICLE.sub(mark, source)
    hidden = re.sub(r"<(/?)(?:article|main|section|nav|header|footer|aside|div)\b(?:[^>]*?(\sdata-main=\"1\"))?[^>]*>", r"<\1div\2>", marked, flags=re.I)
    return [marked, hidden] if seen[0] else []


def words_of(pages: list[str]) -> list[str]:
    """Words that the laid-out pages are filled with."""
    forest = Forest()
    for i, source in enumerate(pages[:50]):
        parse(source, i, forest)
    words = sorted({w for t in forest.text for w in t.split() if w.isalpha() and len(w) < 20})
    return words if len(words) > 200 else [a + b for a in ("ta", "re", "mo", "li", "san", "der", "con", "pi", "u", "bel") for b in ("", "ne", "ros", "ti", "ver", "la", "min", "o")]


class Layouts:
    """Labelled pages laid out at random: what stands around the main text, in what order, under which tags and names."""

    def __init__(self, words: list[str], seed: int = 0):
        self.r, self.words = random.Random(seed), words

    def some(self, low: int, high: int, end: str = "") -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high))) + end

    def sentences(self, low: int, high: int) -> str:
        out = [self.some(2, 16, self.r.choice([".", ".", ".", "!", "?"])).capitalize() for _ in range(self.r.randint(low, high))]
        return " ".join(s.replace(" ", ", ", 1) if self.r.random() < 0.3 else s for s in out)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def box(self, inside: str, tags: str, names: str, main: str = "", bare: float = 0.15) -> str:
        """An element, named by one of the names, or not at all, or by one that tells nothing."""
        tag = self.r.choice(tags.split())
        name = self.r.choice(names.split())
        if tag == "div" and self.chance(bare) or tag != "div" and self.chance(0.5):
            name = self.r.choice(["", "", f"c{self.r.randint(1, 99)}", f"css-{self.r.randint(100, 999)}", "wrap", "inner", "col"])
        name = f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{name}{main and f' data-main="{main}"'}>{inside}</{tag}>"

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{self.r.randint(1, 999)}">{self.some(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: self.r.choice([" | ", " ", " &middot; "]).join(items), lambda: "".join(f"<div>{i}</div>" for i in items)])()

    def menu(self) -> str:
        return self.box(self.links(), "nav nav div ul", "menu main-menu nav navigation breadcrumbs topnav")

    def head(self) -> str:
        inside = self.r.choice([f"<h1>{self.some(1, 3)}</h1>", f'<a href="/">{self.some(1, 3)}</a>', f"<p>{self.some(1, 8)}</p>", f"<div>{self.some(1, 3)}</div>"]) + (self.menu() if self.chance(0.5) else "")
        return self.box(inside, "header header div", "header site-header masthead banner top-bar")

    def foot(self) -> str:
        inside = self.r.choice([f"&copy; {self.some(1, 4)} &middot; {self.sentences(1, 3)}", f"<p>&copy; 2024 {self.some(1, 5)}. {self.sentences(1, 2)}</p>{self.links(2, 6)}", self.links(2, 12), f"<p>{self.sentences(1, 4)}</p>"])
        return self.box(inside, "footer footer div", "footer site-footer bottom colophon copyright legal", bare=0.05)

    def notice(self) -> str:
        return self.box(self.r.choice(["{}", "<p>{}</p>"]).format(self.sentences(1, 4)) + self.r.choice(["", "<button>OK</button>", f'<a href="/p">{self.some(1, 2)}</a>']), "div div aside section", "cookie-notice cookie-banner consent notice gdpr alert popup modal newsletter-signup paywall", bare=0)

    def advert(self) -> str:
        return self.box(self.r.choice(["{}", "<p>{}</p>", "<a href='/x'>{}</a>", "<span>{}</span>"]).format(self.sentences(1, 3)), "div div aside section", "ad ads advert advertisement sponsored ad-slot promo banner-ad", bare=0)

    def form(self) -> str:
        inside = f"<label>{self.some(1, 4)}</label><input name=q><button>{self.some(1, 2)}</button>" + (f"<p>{self.sentences(1, 2)}</p>" if self.chance(0.6) else "")
        return f"<form>{inside}</form>" if self.chance(0.6) else self.box(f"<form action='/s'>{inside}</form>", "div section", "search subscribe login newsletter contact-form", bare=0)

    def side(self) -> str:
        parts = [f"<h3>{self.some(1, 3)}</h3>{self.links()}", f"<p>{self.sentences(1, 3)}</p>", self.advert(), f"<h4>{self.some(1, 4)}</h4><p>{self.sentences(1, 5)}</p>", self.form()]
        return self.box("".join(self.r.sample(parts, self.r.randint(1, 4))), "aside aside div", "sidebar side-bar rail widget-area right-column", bare=0)

    def comments(self) -> str:
        def one() -> str:
            said = self.r.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(self.sentences(1, 5))
            return self.box(self.r.choice(["", f"<b>{self.some(1, 2)}</b>", f"<h4>{self.some(1, 2)}</h4>"]) + said, "div li article", "comment comment-body reply", bare=0.3)

        return self.box(self.r.choice(["", f"<h2>{self.some(1, 3)}</h2>", f"<h3>{self.r.randint(1, 99)} {self.some(1, 1)}</h3>"]) + "".join(one() for _ in range(self.r.randint(1, 7))) + (self.form() if self.chance(0.3) else ""), "section div div ol", "comments comment-list discussion reader-comments responses thread", bare=0)

    def related(self) -> str:
        return self.box(f"<h3>{self.some(1, 3)}</h3>" + self.links(), "div section aside", "related recommended more-stories popular share-links", bare=0)

    def other(self, extra: str) -> str:
        """Something beside the main text, inside its element."""
        return re.sub(r"^<(\w+)", r'<\1 data-main="0"', extra)

    def body(self, plain: bool = False) -> str:
        """Blocks of a main text; plain: each in an element of its own, with nothing between."""
        paragraph = lambda: self.r.choice([self.some(1, 4, "."), self.sentences(1, 2), self.sentences(2, 8), self.sentences(3, 12), self.some(3, 60)])
        out = [f"<h1>{self.some(2, 9)}</h1>"] if self.chance(0.8) else []
        if out and self.chance(0.15):
            out = [f"<header>{out[0]}</header>"]
        if self.chance(0.2):
            out.append(self.box(f"{self.some(1, 3)} 2024", "p div span", "byline meta author date"))
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14])):
            text = paragraph()
            if self.chance(0.15):
                text = text.replace(" ", f' <a href="/a">{self.some(1, 2)}</a> ', 1)
            kinds = [lambda t=text: f"<h3>{self.some(1, 5)}</h3>{t}<br><br>", lambda t=text: f"<p><b>{t}<br>"]
            out.append(
                self.r.choice(
                    ([] if plain else kinds)
                    + [
                        lambda t=text: f"<p>{t}</p>", lambda t=text: f"<p>{t}</p>", lambda t=text: f"<p>{t}</p>", lambda t=text: f"<p>{t}", lambda t=text: f"<h2>{self.some(1, 6)}</h2><p>{t}</p>",
                        lambda t=text: f"<blockquote>{t}</blockquote>", lambda t=text: f"<ul><li>{t}</li><li>{paragraph()}</li></ul>", lambda t=text: f"<div>{t}</div>",
                        lambda t=text: f"<table><tr><th>{self.some(1, 2)}</th><td>{t}</td></tr></table>" if self.chance(0.4) else f"<p>{t}</p>", lambda t=text: f"<figure><img src=x><figcaption>{t}</figcaption></figure><p>{t}</p>",
                    ]
                )()
            )
        for p in () if plain else (0.5, 0.3):
            if self.chance(p):
                inside = self.r.choice([self.advert, self.advert, self.related, self.form, self.notice, self.notice, self.side, self.comments, self.menu, self.foot])
                out.insert(self.r.randint(1, len(out)), self.other(inside()))
        if not plain and self.chance(0.3):  # a frame around all but the heading
            start = 1 if out[0].startswith(("<h1", "<header")) else 0
            out[start:] = [self.box("".join(out[start:]), "div div section", "entry-content article-body post-content text body story-body", bare=0.4)]
        return "".join(out)

    def page(self) -> str:
        before = [f() for f, p in ((self.head, 0.55), (self.menu, 0.5), (self.notice, 0.3), (self.advert, 0.4), (self.form, 0.15), (self.side, 0.12)) if self.chance(p)]
        after = [f() for f, p in ((self.related, 0.25), (self.comments, 0.45), (self.advert, 0.2), (self.notice, 0.15), (self.form, 0.15)) if self.chance(p)]
        self.r.shuffle(before)
        names = "content main-content article-body post-content entry post story text page-body"
        text, plain = self.body(), re.sub(r"<(h\d|p|div|span|blockquote|ul|table|figure|header)\b", r'<\1 data-main="1"', self.body(plain=True))
        main = self.r.choice([lambda: plain, lambda: self.box(text, "article main", names, "1"), lambda: self.box(text, "article section", names, "1"), lambda: self.box(text, "div", names, "1", 0.4), lambda: self.box(self.box(text, "div article section", names, "1", 0.4), "main div", "container wrapper main content", "", 0.3)])()
        middle = main + "".join(after)
        if self.chance(0.4):
            middle = self.box(middle + self.side() if self.chance(0.7) else self.side() + middle, "div div main", "wrapper container columns layout page", bare=0.4)
        end = [self.foot()] if self.chance(0.85) else []
        return f"<html><body>{''.join(before)}{middle}{''.join(end)}" + ("</body></html>" if self.chance(0.85) else "")


def fit(pages: DataFrame, html: str = "html", most: int = PAGES, layouts: int = LAYOUTS) -> Model:
    """The model of a table's own labelled pages and of laid-out ones. Which pages it learns from depends on their content alone."""
    source = F.col(html)
    own = pages.where(F.char_length(source) <= LONGEST).where(source.rlike("(?i)<(article|main)\\b")).select(F.xxhash64(source).alias("h"), source.alias("html"))
    last = own.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    sample = [] if last is None else sorted(r["html"] for r in own.where(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html")).collect())
    made = Layouts(words_of(sample))
    return trained([p for s in sample for p in labelled(s)] + [made.page() for _ in range(layouts)])


def main_texts(pages: DataFrame, model: Model, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = model.texts([s or "" for s in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(tidy("html_text", run), f"page_id {kinds[id_]}, url {kinds[url]}, text string, n_chars long")

"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (runs of text between block-level tags).  A block is
described by its word count and link density, those of its two neighbours, and what its
surroundings say: whether it is in an article or main part, in a menu, header, footer, sidebar
or form, and whether class or id names tell of adverts, notices or comments.  A CART tree is
trained here on the small labelled table of kinds of block below.  It is grown on counts and link densities first; only a leaf
that these leave mixed is split further by the surroundings, as a one-word paragraph and an
advert's sentence have the counts of a menu entry and of an article's sentence.

A name tells of an advert or the like only if all its parts do or say nothing: "comment-list" does, "category-comment" and
"related-work" don't.  What stands around the whole page says nothing either: a form with menus, articles or most of the page's
paragraphs in it isn't a form to fill in, and a main part, or the first article of a page, begins anew.

The scanner reads a page once: a stray end tag is told by a count of open elements, and from the first
quote on that is never closed, tags end at the next > whatever quotes say.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from celldag.llm.common import slices, texts_of

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^'\">]*")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MAY_NEST = re.compile(r"<(?:noscript|template|svg|object)\b", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")
PARTS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")

#: Element names of HTML.
RAW = {"script", "style", "textarea", "title", "iframe"}
#: Skipped too, but they nest, and one that is never closed does not run to the page's end.
NESTED = {"noscript", "template", "svg", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace"}
#: Any of these ends an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Any of these ends an element of NESTED that is never closed.
ENDS_NESTED = ENDS_P | {"body", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}

FURNITURE = {"nav", "menu", "header", "footer", "aside", "button", "select", "dialog", "head"}
#: Parts of class, id or role names, cut at other signs than letters and before capitals.
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal",
    "comment", "comments", "disqus", "respond", "replies", "sidebar", "widget", "related", "recommended", "share", "social", "newsletter", "subscribe", "signup", "login", "search", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "masthead", "complementary", "contentinfo", "dialog", "toolbar", "copyright", "legal", "disclaimer", "tags", "toc",
}
#: Parts that say nothing beside one of HINTS.
PLAIN_PARTS = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "center", "col", "column", "container", "content", "element", "entry", "field", "form", "global", "group", "header",
    "inner", "input", "item", "items", "js", "label", "layer", "left", "link", "links", "list", "main", "meta", "mobile", "module", "outer", "overlay", "page", "panel", "post", "posts", "primary", "region", "reply",
    "right", "row", "secondary", "section", "site", "slot", "small", "story", "stories", "sub", "text", "thread", "title", "top", "unit", "user", "wrap", "wrapper", "x", "zone",
}
BODY = {"article", "main"}
#: A form around any of these holds the page.
PAGE_PARTS = {"article", "main", "nav", "header", "footer", "aside", "h1"}
BODY_HINTS = {"article", "content", "main", "post", "entry", "story", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Form:
    """A form that is open or was: does it hold parts of the page, and how many paragraphs and words."""

    page_parts: bool = False
    paragraphs: int = 0
    words: int = 0

    def holds_page(self, words: int) -> bool:
        return self.page_parts or self.paragraphs > 1 and 2 * self.words > words


@dataclass
class Block:
    text: str
    words: int
    linked: int
    tag: str
    in_body: bool
    in_furniture: bool
    hinted: bool
    form: Form | None = None

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Open:
    tag: str
    in_body: bool
    in_furniture: bool
    hinted: bool
    link: int
    form: Form | None = None


def telling(attributes: str) -> tuple[bool, bool]:
    """Do class, id and role names tell of the page's body, and of adverts, notices, comments and the like."""
    body = hinted = False
    for found in NAMES.findall(attributes):
        for name in "".join(found).split():
            parts = {x.lower() for x in PARTS.findall(name)}
            body |= bool(parts & BODY_HINTS)
            hinted |= bool(parts & HINTS) and parts <= HINTS | PLAIN_PARTS
    return body, hinted


@dataclass
class Token:
    """A tag, or with an empty tag a comment or declaration; the page goes on at `behind` (for RAW elements behind their end tag)."""

    start: int
    end: int
    behind: int
    closing: bool = False
    tag: str = ""
    attributes: str = ""

    @property
    def empty(self) -> bool:
        return self.attributes.endswith("/")


def nested_ends(page: str) -> dict[int, int]:
    """Where each closed element of NESTED ends, by where its start tag ends."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for t in tokens(page):
        if t.tag in NESTED:
            if not t.closing and not t.empty:
                begun.setdefault(t.tag, []).append(t.behind)
            elif t.closing and begun.get(t.tag):
                ends[begun[t.tag].pop()] = t.end
    return ends


def tokens(page: str):
    """Every comment and tag in order.  A < that begins neither, or a tag that nothing ends, is text."""
    at, n, quoted = 0, len(page), True
    raw_end: dict[str, re.Pattern] = {}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield Token(start, at, at)
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield Token(start, at, at)
            continue
        m = TAG.match(page, start)
        if not m:
            at = start + 1
            continue
        end = m.end()
        while quoted:
            end = PLAIN.match(page, end).end()
            if end >= n or page[end] == ">":
                break
            close = page.find(page[end], end + 1)
            if close < 0:
                quoted = False
            else:
                end = close + 1
        if not quoted:
            end = page.find(">", m.end())
        if end < 0 or end >= n:
            return
        at, tag = end + 1, m[2].lower()
        found = Token(start, at, at, bool(m[1]), tag, page[m.end() : end])
        if tag in RAW and not found.closing and not found.empty:
            ending = raw_end.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I)).search(page, at)
            at = ending.end() if ending else n
            found.behind = at
        yield found


@dataclass
class Flattener:
    """Turns a page into blocks.  An end tag closes what it opened, and all that was left open inside."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, False, False, 0)])
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    opened: Counter = field(default_factory=Counter)
    begun: bool = False  # an article, or text of the page's body, was met

    def cut(self, at: int) -> None:
        """Close all elements from this place of the stack on."""
        for o in self.stack[at:]:
            self.opened[o.tag] -= 1
            self.opened["nested"] -= o.tag in NESTED
        del self.stack[at:]

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.pieces)).strip()
        if text:
            top = self.stack[-1]
            tag = next((o.tag for o in reversed(self.stack) if o.tag not in INLINE), "")
            block = Block(text, max(1, len(WORD.findall(text))), self.linked, tag, top.in_body, top.in_furniture, top.hinted, top.form)
            self.blocks.append(block)
            self.begun |= top.in_body and not (top.in_furniture or top.hinted)
            if top.form:
                top.form.words += block.words
                top.form.paragraphs += tag == "p" and not block.linked
        self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            shown = html.unescape(raw)
            self.pieces.append(shown)
            if self.stack[-1].link:
                self.linked += len(WORD.findall(shown))

    def close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if any(o.tag not in INLINE for o in self.stack[i:]):
                    self.flush()
                self.cut(i)
                return
            if self.stack[i].tag not in INLINE and tag in INLINE:
                return  # a stray end tag of an element that was opened outside this block

    def open(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            # Inline elements that were left open end with their paragraph.
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == "p":
                    self.flush()
                    self.cut(i)
                    break
                if self.stack[i].tag not in INLINE:
                    break
        if tag in ENDS_NESTED and self.opened["nested"]:
            for i in range(1, len(self.stack)):
                if self.stack[i].tag in NESTED:
                    self.flush()
                    self.cut(i)
                    break
        if tag not in INLINE:
            self.flush()
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                if self.stack[-1].tag == tag:
                    self.cut(len(self.stack) - 1)
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        top = self.stack[-1]
        told = "=" in attributes and tag not in ("html", "body")  # names there speak of the whole page
        body, hinted = telling(attributes) if told else (False, False)
        body |= tag in BODY
        form = top.form
        if form and tag in PAGE_PARTS:
            form.page_parts = True
        if tag == "form":
            form = Form()
        anew = tag == "main" or tag == "article" and not self.begun
        self.begun |= tag in BODY
        own_title = tag == "header" and top.in_body
        furniture = (tag in FURNITURE or tag in NESTED) and not own_title
        self.opened[tag] += 1
        self.opened["nested"] += tag in NESTED
        self.stack.append(_Open(tag, top.in_body or body, top.in_furniture or furniture, (top.hinted and not anew) or hinted and not own_title and tag != "main", top.link + (tag == "a"), form))

    def run(self, page: str) -> list[Block]:
        ends = nested_ends(page) if MAY_NEST.search(page) else {}
        at = 0
        for t in tokens(page):
            if t.start < at:
                continue  # inside an element that is skipped
            self.text(page[at : t.start])
            at = t.behind
            if t.closing:
                self.close(t.tag)
            elif t.tag in NESTED:
                at = ends.get(t.behind, t.behind)
                if t.behind not in ends and not t.empty:
                    self.open(t.tag, t.attributes)
            elif t.tag and t.tag not in RAW:
                self.open(t.tag, t.attributes)
        self.text(page[at:])
        self.flush()
        words = sum(b.words for b in self.blocks)
        for b in self.blocks:
            b.in_furniture |= b.form is not None and not b.form.holds_page(words)
        return self.blocks


DEALT = 6  # the first features: counts and densities of the block and its neighbours
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_body", "in_furniture", "hinted", "heading", "item")


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block; beyond the page's ends there are 0 words."""
    own = np.array([[b.words, b.link_density] for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    around = np.array([[b.in_body, b.in_furniture, b.hinted, b.tag in HEADINGS, b.tag in ("li", "td", "th", "dt", "dd")] for b in blocks], float).reshape(-1, 5)
    return np.hstack([own, np.vstack([edge, own[:-1]])[: len(own)], np.vstack([own[1:], edge])[: len(own)], around])


#: The labelled table, made by hand: kinds of block as they follow each other on pages.  Of each: least and most words, least and most link density,
#: in_body, in_furniture, hinted, heading, item, and 1 for content.  Pages without telling elements or names have kinds of their own.
KINDS = {
    "site title": (1, 6, 0.0, 0.4, 0, 1, 0, 1, 0, 0), "tagline": (3, 12, 0.0, 0.0, 0, 1, 0, 0, 0, 0), "menu": (1, 4, 1.0, 1.0, 0, 1, 0, 0, 1, 0), "named menu": (1, 4, 1.0, 1.0, 0, 0, 1, 0, 1, 0),
    "breadcrumb": (2, 8, 0.6, 1.0, 0, 0, 1, 0, 0, 0), "notice": (4, 40, 0.0, 0.3, 0, 0, 1, 0, 0, 0), "notice form": (1, 12, 0.0, 0.0, 0, 1, 0, 0, 0, 0),
    "title": (1, 14, 0.0, 0.0, 1, 0, 0, 1, 0, 1), "subheading": (1, 9, 0.0, 0.2, 1, 0, 0, 1, 0, 1), "paragraph": (8, 160, 0.0, 0.3, 1, 0, 0, 0, 0, 1), "short paragraph": (1, 9, 0.0, 0.2, 1, 0, 0, 0, 0, 1),
    "linked paragraph": (1, 12, 0.5, 1.0, 1, 0, 0, 0, 0, 1), "list item": (1, 30, 0.0, 0.3, 1, 0, 0, 0, 1, 1), "linked item": (1, 8, 0.5, 1.0, 1, 0, 0, 0, 1, 1),
    "advert": (2, 70, 0.0, 0.5, 0, 0, 1, 0, 0, 0), "advert inside": (2, 70, 0.0, 0.5, 1, 0, 1, 0, 0, 0), "share links": (1, 3, 1.0, 1.0, 1, 0, 1, 0, 1, 0), "aside inside": (3, 60, 0.0, 0.6, 1, 1, 0, 0, 0, 0), "form inside": (1, 12, 0.0, 0.0, 1, 1, 0, 0, 0, 0),
    "comment": (2, 120, 0.0, 0.2, 0, 0, 1, 0, 0, 0), "comment inside": (2, 120, 0.0, 0.2, 1, 0, 1, 0, 0, 0), "comment heading": (1, 4, 0.0, 0.0, 1, 0, 1, 1, 0, 0),
    "aside heading": (1, 5, 0.0, 0.0, 0, 1, 0, 1, 0, 0), "aside text": (4, 60, 0.0, 0.4, 0, 1, 0, 0, 0, 0), "aside link": (2, 9, 1.0, 1.0, 0, 1, 0, 0, 1, 0), "form": (1, 12, 0.0, 0.1, 0, 1, 0, 0, 0, 0),
    "footer": (3, 40, 0.0, 0.4, 0, 1, 0, 0, 0, 0), "footer link": (1, 3, 1.0, 1.0, 0, 1, 0, 0, 1, 0),
    "bare menu": (1, 5, 1.0, 1.0, 0, 0, 0, 0, 1, 0), "bare link": (1, 7, 0.7, 1.0, 0, 0, 0, 0, 0, 0), "bare title": (2, 14, 0.0, 0.0, 0, 0, 0, 1, 0, 1), "bare paragraph": (10, 160, 0.0, 0.3, 0, 0, 0, 0, 0, 1), "bare item": (6, 30, 0.0, 0.2, 0, 0, 0, 0, 1, 1),
    "bare short paragraph": (1, 9, 0.0, 0.7, 0, 0, 0, 0, 0, 1), "bare footer": (2, 9, 0.0, 0.6, 0, 0, 0, 0, 0, 0),
}
BODY_PARTS = ("paragraph", "paragraph", "paragraph", "short paragraph", "subheading", "list item", "list item", "linked paragraph", "linked item")
#: What a page is made of, in order: kinds (one is taken for each block) and how many blocks at least and at most.
LAYOUTS = [
    [(("site title",), 0, 1), (("tagline",), 0, 1), (("menu", "named menu"), 0, 7), (("breadcrumb",), 0, 1), (("notice", "notice form"), 0, 2), (("title",), 0, 1), (BODY_PARTS, 1, 6), (("advert inside", "aside inside", "form inside"), 0, 1), (BODY_PARTS, 0, 5),
     (("share links",), 0, 3), (("comment heading",), 0, 1), (("comment", "comment inside"), 0, 4), (("advert",), 0, 1), (("aside heading",), 0, 1), (("aside text", "aside link"), 0, 5), (("form",), 0, 2), (("footer link",), 0, 4), (("footer",), 0, 2)],
    [(("bare menu", "bare link"), 0, 6), (("bare title",), 0, 1), (("bare paragraph", "bare paragraph", "bare item"), 1, 4), (("bare short paragraph",), 0, 1), (("bare paragraph", "bare item"), 1, 4), (("advert", "notice"), 0, 1), (("bare paragraph",), 0, 4), (("bare link",), 0, 3), (("bare footer",), 0, 1)],
]


def labelled_blocks(pages: int = 600, seed: int = 11) -> list[tuple]:
    """FEATURES in order, then 1 for content, of the blocks of so many pages put together from the labelled kinds; two in three have telling elements."""
    rng, rows = random.Random(seed), []
    for i in range(pages):
        kinds = [KINDS[rng.choice(names)] for names, low, high in LAYOUTS[i % 3 == 2] for _ in range(rng.randint(low, high))]
        drawn = [(max(1, round(math.exp(rng.uniform(math.log(k[0]), math.log(k[1]))))), rng.uniform(k[2], k[3]) if rng.random() < 0.5 else rng.choice(k[2:4])) for k in kinds]
        for j, k in enumerate(kinds):
            before, after = (drawn[j - 1] if j else (0, 0.0)), (drawn[j + 1] if j + 1 < len(drawn) else (0, 0.0))
            rows.append((*drawn[j], *before, *after, *k[4:]))
    return rows


@dataclass
class Tree:
    """Leaves have feature -1; value: share of content."""

    feature: int
    cut: float
    value: float
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0 or not len(x):
            return np.full(len(x), self.value)
        out, below = np.empty(len(x)), x[:, self.feature] <= self.cut
        out[below], out[~below] = self.low.predict(x[below]), self.high.predict(x[~below])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2, columns: range | None = None) -> Tree:
    """CART by Gini impurity on these columns; ties go to the first feature, then the lowest cut."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return Tree(-1, 0.0, share)
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for j in columns or range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        impurity = t[:-1] * (1 - t[:-1] / n) + (t[-1] - t[:-1]) * (1 - (t[-1] - t[:-1]) / (len(y) - n))
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        i = int(impurity.argmin())
        if impurity[i] < best[0] - 1e-12:
            best = (float(impurity[i]), j, (v[i] + v[i + 1]) / 2)
    _, j, cut = best
    if j < 0:
        return Tree(-1, 0.0, share)
    below = x[:, j] <= cut
    return Tree(j, cut, share, grow(x[below], y[below], depth - 1, least, columns), grow(x[~below], y[~below], depth - 1, least, columns))


def refine(tree: Tree, x: np.ndarray, y: np.ndarray, depth: int, least: int, columns: range | None = None) -> Tree:
    """The tree with its mixed leaves split further, by these columns."""
    if tree.feature < 0:
        return grow(x, y, depth, least, columns)
    below = x[:, tree.feature] <= tree.cut
    return Tree(tree.feature, tree.cut, tree.value, refine(tree.low, x[below], y[below], depth, least, columns), refine(tree.high, x[~below], y[~below], depth, least, columns))


def train(labelled=None, depth: int = 4, least: int = 20) -> Tree:
    """Counts and densities split first, `depth` deep with `least` rows a leaf; then mixed leaves by their surroundings, and what is still mixed by everything."""
    table = np.array(labelled_blocks() if labelled is None else labelled, float)
    x, y = table[:, :-1], table[:, -1]
    tree = grow(x, y, depth, least, range(DEALT))
    return refine(refine(tree, x, y, len(FEATURES) - DEALT, 2, range(DEALT, len(FEATURES))), x, y, depth, least // 2)


def deciding(tree: Tree, x: np.ndarray) -> list[str]:
    """For each block the feature of the last split on its way, from which on the decision stays what it is."""
    out = []
    for row in x:
        path, at = [], tree
        while at.feature >= 0:
            path.append((at, FEATURES[at.feature]))
            at = at.low if row[at.feature] <= at.cut else at.high
        end, name = at.value >= 0.5, ""
        for node, name in reversed(path):
            if not _one_sided(node, end):
                break
        out.append(name)
    return out


def _one_sided(tree: Tree, value: bool) -> bool:
    if tree.feature < 0:
        return (tree.value >= 0.5) == value
    return _one_sided(tree.low, value) and _one_sided(tree.high, value)


def main_text(page: str, tree: Tree) -> str:
    blocks = Flattener().run(page)
    keep = tree.predict(features(blocks)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row, from its whole html.

    Null or empty html, and pages without content, give the empty text.  Repeated rows are
    extracted each; further columns are ignored.
    """
    tree = tree or train()
    schema = pages.schema
    kinds = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(t, tree) for t in texts_of(batch, "html")]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")

"""Main text of web pages by wrapper induction.

All pages of a host are aligned: simple tree matching (the order-preserving matching of children that pairs
the most nodes) maps pages to a pivot page; a page that matches no pivot well starts a template of its own. A
template is what most of its pages share: its nodes, and of each node whether it is constant (the same text on
all pages, or on nine of ten where there are so many) or a slot that varies.

Every page of the host is then aligned with the host's templates, and the best one tells its parts apart:
constant nodes are template and go, slots and what no template knows are content. Some parts vary from page
to page and still are no main text: elements made for that (nav, footer, aside, form, ...), lists of links,
and, as a tie-break, elements with a telling class or id. A word like "related" or "search" alone decides
nothing: it takes a node that the template has, or links. If a page has article or main elements, only they
are read, and nothing constant is taken out of them.

A host may have any number of pages: they are dealt by hash into chunks of CHUNK at most, each chunk is aligned
to templates with counts, and templates are aligned and added up in the same way, until a host has no more than
a chunk of them. Only where that no longer halves the largest host, whose templates then are unlike, one task
takes all that are left of a host. A constant node goes only where the very same text stands, and pages without
a fitting template are read without one. Pages whose text no template can change are read where they are first
parsed.

Alignment works on interned subtrees: equal ends of two rows of children are paired at once, equal pairs of
subtrees are matched once, and rows of more than CELLS cells are halved until their parts have no more, at the place
where the best matchings of both parts make the best of all. Nothing recurses.

Templates are one short row per host. Up to BROADCAST_CHARS they are broadcast, otherwise joined by host
(pages of a hot host are split by the adaptive skew join); the pages' text is the same.

Cases: a null html is an empty page with empty text; a null or odd url has host '' (one host like any
other); truncated or nested markup is read as far as it goes; very long pages are read whole and
take part in templates; hosts of fewer than LEAST different pages have no template; repeated pages
and ids each give a row; an empty table gives an empty result. The result has only its own columns.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.common import Scratch, materialize

CHUNK = 64  #: pages, or templates, that are aligned at once
LEAST = 3  #: different pages that make a template
SHARED = 0.6  #: of a template's pages have each of its nodes
ALIKE = 0.5  #: of the nodes of the smaller of two pages that match, for one template
SAME = 0.9  #: of a node's pages have its text, if it is constant
LINKS = 0.7  #: share of a menu's text in links
BROADCAST_CHARS = 1 << 25
FOUND = 1 << 18  #: matches of subtrees that a batch of pages remembers
CELLS = 1 << 20  #: of a table of children against children that is held at once

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that never hold main text.
NEVER = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "dialog", "menu"}
#: Words of class, id or role that mark a part as no main text, alone or as part of a name like site-footer.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus",
    "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "replies", "sidebar", "social", "sponsor", "sponsored",
}
#: Words that may as well name a part of the main text: only with other evidence.
HINTS = {"login", "related", "search", "share", "sharing", "signup", "subscribe", "toolbar", "widget"}
#: Marks outside article and main.
OUTER_MARKS = {"header", "masthead"}
REGIONS = {"article", "main"}
#: Opening one of these closes an open one of the second set first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in ("p", "div", "article", "section", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "nav", "aside", "footer", "header", "main", "figure", "hr")},
}


@lru_cache(1 << 12)
def _told(tag: str, class_: str, id_: str, role: str) -> tuple[str, bool, bool, bool, bool, bool]:
    """Label, marked, part_marked, hinted, outer and region of an element."""
    names = f"{class_} {id_} {role}".lower().split()
    parts = set(re.split(r"[^a-z0-9]+", " ".join(names)))
    return (
        f"{tag}.{' '.join(sorted(class_.lower().split()))}", not MARKS.isdisjoint(names), not MARKS.isdisjoint(parts), not HINTS.isdisjoint(names),
        tag == "header" or not OUTER_MARKS.isdisjoint(parts), tag in REGIONS or role == "main",
    )


class Node:
    __slots__ = ("tag", "label", "children", "never", "marked", "part_marked", "hinted", "outer", "region")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]):
        named = dict(attrs) if attrs else {}
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        self.tag = tag
        self.never = hidden or tag in NEVER
        self.label, self.marked, self.part_marked, self.hinted, self.outer, self.region = _told(tag, named.get("class") or "", named.get("id") or "", named.get("role") or "")
        self.children: list[Node | str] = []


class Builder(HTMLParser):
    """A tolerant tree: unknown nesting is kept, unclosed elements end with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("#root", [])]
        self.tags: dict[str, int] = {}  # open elements by tag

    def close_from(self, i: int) -> None:
        for node in self.open[i:]:
            self.tags[node.tag] -= 1
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        closed = CLOSES.get(tag)
        if closed and any(self.tags.get(t) for t in closed):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in closed:
                    self.close_from(i)
                    break
                if self.open[i].tag not in INLINE:
                    break
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.tags[tag] = self.tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.tags.get(tag):
            self.close_from(max(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag) if self.open[-1].tag != tag else len(self.open) - 1)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


def elements(root: Node) -> list[tuple[Node, int]]:
    """All elements, each before its descendants, with the place of its parent."""
    out, stack = [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        out.append((node, parent))
        stack += [(c, len(out) - 1) for c in reversed(node.children) if isinstance(c, Node)]
    return out


def own_text(node: Node) -> str:
    """The node's text together with that of inline elements below it."""
    parts, stack = [], [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            parts.append(child)
        elif child.tag in INLINE and not child.never:
            stack.append(iter(child.children))
    return " ".join("".join(parts).split())


def digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) << 20 | len(text) & 0xFFFFF


class Shapes:
    """Interned subtrees: a number for each label with the numbers of its children."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.found: dict[tuple[int, int], tuple[int, list[tuple[int, int]] | None]] = {}

    def number(self, label: str, kids: tuple[int, ...]) -> int:
        n = self.numbers.setdefault((label, kids), len(self.label))
        if n == len(self.label):
            self.label.append(label)
            self.kids.append(kids)
            self.size.append(1 + sum(self.size[k] for k in kids))
        return n

    def match(self, x: int, y: int) -> int:
        """Simple tree matching of two subtrees: the number of pairs of an order-preserving matching of equal
        labels. ``found`` then has it for all pairs that it is made of, with the pairs of children."""
        stack = [(x, y)]
        while stack:
            a, b = stack[-1]
            if (a, b) in self.found or a == b or self.label[a] != self.label[b]:
                if (a, b) not in self.found:
                    self.found[a, b] = (self.size[a], None) if a == b else (0, [])
                stack.pop()
                continue
            left, right = self.kids[a], self.kids[b]
            head = 0
            while head < min(len(left), len(right)) and left[head] == right[head]:
                head += 1
            tail = 0
            while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
                tail += 1
            mid, other = left[head : len(left) - tail], right[head : len(right) - tail]
            large = len(mid) * len(other) > CELLS
            open_ = self._unknown(mid, other) if large else [(p, q) for p in set(mid) for q in set(other) if (p, q) not in self.found]
            if open_:
                stack += open_
                continue
            pairs = self._best_by_halves(mid, other) if large else self._best(mid, other)
            ends = [(i, i) for i in range(head)] + [(len(left) - 1 - i, len(right) - 1 - i) for i in range(tail)]
            pairs = ends + [(i + head, j + head) for i, j in pairs]
            score = 1 + sum(self.found[left[i], right[j]][0] if left[i] != right[j] else self.size[left[i]] for i, j in pairs)
            self.found[a, b] = score, pairs
            stack.pop()
        return self.found[x, y][0]

    def _by_label(self, shapes: Iterable[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for n in sorted(set(shapes)):
            out.setdefault(self.label[n], []).append(n)
        return out

    def _unknown(self, mid: tuple[int, ...], other: tuple[int, ...]) -> list[tuple[int, int]]:
        """Different subtrees of one label that aren't matched yet, CELLS at once."""
        same = self._by_label(other)
        return list(islice(((p, q) for p in sorted(set(mid)) for q in same.get(self.label[p], ()) if p != q and (p, q) not in self.found), CELLS))

    def _best_by_halves(self, mid: tuple[int, ...], other: tuple[int, ...]) -> list[tuple[int, int]]:
        """What ``_best`` pairs, or as much, with rows of the table only: the rows are halved where the scores of
        the upper ones, from the front, and of the lower ones, from the back, add up to the most."""
        xs = np.array(mid)
        ys, at = np.unique(np.array(other), return_inverse=True)
        column = {q: k for k, q in enumerate(ys.tolist())}
        same = self._by_label(other)

        @lru_cache(max(1, 4 * CELLS // len(ys)))
        def weights(p: int) -> np.ndarray:
            row = np.zeros(len(ys), np.int64)
            for q in same.get(self.label[p], ()):
                row[column[q]] = self.size[p] if p == q else self.found[p, q][0]
            return row

        def scores(rows: list[int], columns: np.ndarray) -> np.ndarray:
            best = np.zeros(len(columns) + 1, np.int64)
            for p in rows:
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights(p)[columns]))
            return best

        out, stack = [], [(0, len(mid), 0, len(other))]
        while stack:
            i, end, j, last = stack.pop()
            if i == end or j == last:
                continue
            if end - i == 1:
                row = weights(mid[i])[at[j:last]]
                if row.max():
                    out.append((i, j + int(row.argmax())))
            elif (end - i) * (last - j) <= CELLS:
                table = np.array([weights(p)[at[j:last]] for p in mid[i:end]])
                out += [(i + a, j + b) for a, b in _heaviest(table)]
            else:
                half, columns = (i + end) // 2, at[j:last]
                cut = j + int((scores(xs[i:half].tolist(), columns) + scores(xs[half:end][::-1].tolist(), columns[::-1])[::-1]).argmax())
                stack += [(half, end, cut, last), (i, half, j, cut)]
        return out

    def _best(self, mid: tuple[int, ...], other: tuple[int, ...]) -> list[tuple[int, int]]:
        if not mid or not other:
            return []
        (xs, a), (ys, b) = (np.unique(np.array(x), return_inverse=True) for x in (mid, other))
        return _heaviest(np.array([[self.found[p, q][0] for q in ys.tolist()] for p in xs.tolist()], np.int64)[a][:, b])


def _heaviest(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, in the order of both, of the largest sum of weights."""
    n, m = weight.shape
    best = np.zeros((n + 1, m + 1), np.int64)
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + weight[i]))
    out, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


class Tree:
    """The frame of a page, or a template: block elements that may hold main text, parents first."""

    def __init__(self, shapes: Shapes, labels: list[str], parents: list[int]):
        self.shapes, self.labels, self.kids = shapes, labels, [[] for _ in labels]
        for i, parent in enumerate(parents):
            if parent >= 0:
                self.kids[parent].append(i)
        self.numbers = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            self.numbers[i] = shapes.number(labels[i], tuple(self.numbers[k] for k in self.kids[i]))

    def pairs(self, other: Tree) -> list[tuple[int, int]]:
        """Places of both trees that simple tree matching pairs."""
        if not self.shapes.match(self.numbers[0], other.numbers[0]):
            return []
        out, stack = [], [(0, 0)]
        while stack:
            a, b = stack.pop()
            out.append((a, b))
            x, y = self.numbers[a], other.numbers[b]
            inner = self.shapes.found[x, y][1] if x != y else None
            inner = zip(range(len(self.kids[a])), range(len(other.kids[b])), strict=True) if inner is None else inner
            stack += [(self.kids[a][i], other.kids[b][j]) for i, j in inner]
        return out


class Page:
    """A parsed page: its elements with their parents, lengths of text and of text in links, and its frame."""

    def __init__(self, html: str | None, shapes: Shapes):
        self.root = parse(html)
        self.elements = elements(self.root)
        n = len(self.elements)
        self.chars, self.linked, self.links, self.regions = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            node, parent = self.elements[i]
            if node.never:
                self.chars[i] = self.linked[i] = self.links[i] = self.regions[i] = 0
                continue
            self.chars[i] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
            if node.tag == "a":
                self.linked[i], self.links[i] = self.chars[i], 1
            if parent >= 0:
                for sums in (self.chars, self.linked, self.links):
                    sums[parent] += sums[i]
                self.regions[parent] += self.regions[i] + (node.region and self.chars[i] > 0)
        labels, parents, self.frame, place = [], [], [], [-1] * n
        for i, (node, parent) in enumerate(self.elements):
            if parent >= 0 and place[parent] < 0 or node.never:
                continue
            if parent >= 0 and (node.tag in INLINE or node.tag in VOID):
                place[i] = place[parent]  # blocks in inline elements belong to the block around them
                continue
            place[i] = len(labels)
            labels.append(node.label)
            parents.append(place[parent] if parent >= 0 else -1)
            self.frame.append(i)
        self.tree = Tree(shapes, labels, parents)


def frame(page: Page) -> dict:
    """Labels, parents and digests of texts of a page's frame."""
    up = {k: i for i, kids in enumerate(page.tree.kids) for k in kids}
    texts = [digest(own_text(page.elements[i][0])) for i in page.frame]
    return {"labels": page.tree.labels, "parents": [up.get(i, -1) for i in range(len(texts))], "texts": texts}


def counted(frame: dict, pages: int) -> dict:
    """The template of pages that all have one frame. ``seen``: pages that have each node; ``lead``: how far the
    node's text is ahead of all others together, when differing texts are struck off against each other."""
    n = len(frame["labels"])
    return {**frame, "pages": pages, "seen": [pages] * n, "lead": [pages] * n}


def aligned(states: list[dict]) -> list[dict]:
    """Templates with counts, each added to the first one of those before it that it matches best, if well."""
    shapes = Shapes()
    groups: list[tuple[Tree, Counter, dict]] = []
    for state in states:
        tree, bag = Tree(shapes, state["labels"], state["parents"]), Counter(state["labels"])
        share, into, pairs = 0.0, None, []
        for pivot, labels, sums in groups:
            least = min(len(pivot.labels), len(tree.labels))
            bound = sum((bag & labels).values()) / least  # no matching pairs more
            if bound < ALIKE or bound <= share:
                continue
            found = pivot.pairs(tree)
            if len(found) / least > share:
                share, into, pairs = len(found) / least, sums, found
        if into is None or share < ALIKE:
            groups.append((tree, bag, {**state, "texts": list(state["texts"]), "seen": list(state["seen"]), "lead": list(state["lead"])}))
            continue
        into["pages"] += state["pages"]
        for i, j in pairs:
            into["seen"][i] += state["seen"][j]
            lead = state["lead"][j] if into["texts"][i] == state["texts"][j] else -state["lead"][j]
            into["lead"][i] += lead
            if into["lead"][i] < 0:
                into["texts"][i], into["lead"][i] = state["texts"][j], -into["lead"][i]
    return [state for _, _, state in groups]


def templates_of(states: list[dict]) -> list[dict]:
    """Templates of a host: labels, parents and digests of constant texts (null: a slot) of the nodes that most of
    a template's pages share. A text on SAME of a node's pages leads by 2 * SAME - 1 of them, at least."""
    out = []
    for state in states:
        if state["pages"] < LEAST:
            continue
        place, labels, parents, constant = {}, [], [], []
        for i, (label, parent, seen) in enumerate(zip(state["labels"], state["parents"], state["seen"], strict=True)):
            if seen >= max(LEAST, SHARED * state["pages"]) and (i == 0 or parent in place):
                place[i] = len(labels)
                labels.append(label)
                parents.append(place[parent] if i else -1)
                constant.append(state["texts"][i] if state["lead"][i] >= (2 * SAME - 1) * seen - 1e-9 else None)
        out.append({"labels": labels, "parents": parents, "constant": constant})
    return out


def induce(htmls: list[str]) -> list[dict]:
    """Templates of a host's pages, aligned at once."""
    return templates_of(aligned([counted(frame(Page(h, Shapes())), 1) for h in dict.fromkeys(htmls)]))


class Templates:
    """Templates of a host (JSON) as trees; matches of subtrees are remembered from page to page."""

    def __init__(self, templates: str | None):
        self.shapes = Shapes()
        self.trees = [(Tree(self.shapes, t["labels"], t["parents"]), Counter(t["labels"]), t["constant"]) for t in json.loads(templates or "[]")]


def fitted(page: Page, templates: Templates) -> dict[int, int | None]:
    """Elements of the page that its best template has, with the digests of its constant texts."""
    best: dict[int, int | None] = {}
    bag = Counter(page.tree.labels) if templates.trees else Counter()
    for tree, labels, constant in templates.trees:
        least, bound = ALIKE * min(len(tree.labels), len(page.frame)), sum((bag & labels).values())
        if bound < least or bound <= len(best):  # no matching pairs more
            continue
        pairs = tree.pairs(page.tree)
        if len(pairs) >= least and len(pairs) > len(best):
            best = {page.frame[j]: constant[i] for i, j in pairs}
    return best


def blocks(page: Page, start: int, known: dict[int, int | None], inside: bool, whole: bool) -> list[str]:
    """Texts of the blocks below an element, in page order, without what is no main text. inside: of an article
    or main element; whole: constant texts stay."""
    out: list[str] = []
    held: list[str] = []
    place = {id(node): i for i, (node, _) in enumerate(page.elements)}

    def gone(i: int, node: Node) -> bool:
        if node.never:
            return True
        if page.regions[i]:
            return False  # what holds an article goes with it, whatever it is called
        linked = page.links[i] > 1 and page.linked[i] >= LINKS * page.chars[i]
        if node.marked or node.part_marked and 2 * page.chars[i] < page.chars[0]:
            return True
        if node.hinted and (i in known or linked):
            return True
        return not inside and (node.outer or linked and node.tag not in INLINE)

    def cut() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    def silent(i: int, node: Node) -> bool:
        constant = None if whole or inside else known.get(i)
        return constant is not None and constant == digest(own_text(node))

    node = page.elements[start][0]
    stack = [(iter(node.children), True, silent(start, node))]  # children, block, whether its own text goes
    while stack:
        children, block, quiet = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if block:
                cut()
        elif isinstance(child, str):
            if not quiet:
                held.append(child)
        elif not gone(i := place[id(child)], child):
            if child.tag == "br":
                held.append(" ")
            elif child.tag in VOID:
                if child.tag not in INLINE:
                    cut()
            elif child.tag in INLINE:
                stack.append((iter(child.children), False, quiet))
            else:
                cut()
                stack.append((iter(child.children), True, silent(i, child)))
    return out


def of_regions(page: Page, known: dict[int, int | None]) -> list[str]:
    """Texts of the blocks of the outermost article and main elements."""
    outside, starts = {0}, []
    for i, (node, parent) in enumerate(page.elements[1:], 1):
        if parent in outside and not node.never:
            if node.region and page.chars[i] and not node.marked:
                starts.append(i)
            else:
                outside.add(i)
    return [t for i in starts for t in blocks(page, i, known, True, True)]


def settled(page: Page) -> str | None:
    """The text of a page that no template can change: in articles only elements with HINTS depend on one."""
    if not page.regions[0] or any(node.hinted for node, _ in page.elements):
        return None
    return "\n".join(of_regions(page, {})) or None


def extract(html: str | None, templates: str | None | Templates) -> str:
    """The main text of a page; templates: of its host, as ``wrappers`` gives them."""
    known_to = templates if isinstance(templates, Templates) else Templates(templates)
    page = Page(html, known_to.shapes)
    known = fitted(page, known_to)
    found = of_regions(page, known) if page.regions[0] else []
    return "\n".join(found or blocks(page, 0, known, False, False) or blocks(page, 0, known, False, True))


def read(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, host) parsed: html where the text waits for templates, else text; state, the
    frame as JSON (null without html); page, a hash of the html."""
    schema = T.StructType([pages.schema["page_id"], *[T.StructField(c, T.StringType()) for c in ("url", "host", "html", "text", "state")], T.StructField("page", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                left, texts, states = part.column("html").to_pylist(), [], []
                for i, html in enumerate(left):
                    parsed = Page(html, Shapes())
                    texts.append("" if html is None else settled(parsed))
                    states.append(None if html is None else json.dumps(frame(parsed), separators=(",", ":")))
                    left[i] = html if texts[-1] is None else None
                columns = [part.column("page_id"), part.column("url"), part.column("host"), *[pa.array(c, pa.string()) for c in (left, texts, states)], part.column("page")]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return pages.select("page_id", "url", "host", "html", F.xxhash64("html").alias("page")).mapInArrow(run, schema)


def _opened(rows: pd.DataFrame) -> list[dict]:
    """States in an order of their own, whatever order the rows come in, those of many pages first."""
    ordered = rows.sort_values(["n", "state"], ascending=[False, True])
    return [s if "seen" in (s := json.loads(state)) else counted(s, n) for state, n in zip(ordered["state"], ordered["n"].tolist(), strict=True)]


def wrappers(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """host and templates (JSON) of every host that has any, from all pages (host, state, page)."""
    frames = pages.where("state is not null").groupBy("host", "state").agg(F.count_distinct("page").alias("n"))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        found = aligned(_opened(rows))
        return pd.DataFrame({"host": rows["host"].iloc[0], "state": [json.dumps(s, separators=(",", ":")) for s in found], "n": [s["pages"] for s in found]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        found = templates_of(aligned(_opened(rows)))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "templates": [json.dumps(found)]}) if found else pd.DataFrame({"host": [], "templates": []}, dtype=str)

    with Scratch(pages.sparkSession) as scratch:
        states, last = scratch.write(frames), None
        while True:
            held = states.groupBy("host").agg(F.count("*").alias("held"))
            most = held.agg(F.max("held")).first()[0] or 0
            if most <= chunk or last and 2 * most > last:
                break
            part = F.pmod(F.xxhash64("state"), F.ceil(F.col("held") / chunk))
            dealt = states.join(held, "host").select("host", "state", "n", F.concat(part.cast("string"), F.lit(" "), "host").alias("part"))  # one key: not all of a host in one task
            states, last = scratch.write(dealt.groupBy("part").applyInPandas(add, "host string, state string, n bigint")), most
        return materialize(states.groupBy("host").applyInPandas(learn, "host string, templates string"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    parsed = materialize(read(rows))
    learned = wrappers(parsed)
    few = (learned.agg(F.sum(F.length("templates"))).first()[0] or 0) <= BROADCAST_CHARS
    joined = parsed.select("page_id", "url", "host", "html", "text").join(F.broadcast(learned) if few else learned, "host", "left").drop("host")
    schema = T.StructType([joined.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts, known = part.column("text").to_pylist(), {}
                for i, (h, t) in enumerate(zip(part.column("html").to_pylist(), part.column("templates").to_pylist(), strict=True)):
                    if texts[i] is not None:
                        continue
                    if t not in known or len(known[t].shapes.found) > FOUND:
                        known[t] = Templates(t)
                    texts[i] = extract(h, known[t])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)

"""Main text of web pages by a tree-structured graphical model of the DOM.

Elements are nodes with two states (content or not). A node's own potential is a sum of learned weights of its features:
its tag, the cues in its class, id and role, how much text it has, how much of that is links, whether it has sentences,
paragraphs and a title. An edge potential couples a node with its parent; it is one of four tables, by whether the child is
marked (has a cue, or a tag that says what it is) and whether the parent is a bare wrapper. All weights are fitted by maximum
likelihood of the labels of the pages of ``html_training`` (nodes without a label are summed out). Sum-product messages go up
from the leaves and down from the root, which gives each node's exact marginal; text of nodes with a marginal of 0.5 or more
is kept.

Scripts, styles, comments, the head and elements that aren't shown (hidden, display:none) have no text. Tags may be
unclosed, misnested or in any case; the parser takes time linear in the page. A tag that never ends goes with all that
follows it, as in browsers. A null or empty page gives an empty text. Very long pages are taken whole; equal pages give
equal texts; extra columns stay, and the new one gets leading underscores if its name is taken; an empty table gives an
empty result. Character references are decoded once. White space in a block becomes one space (``<br>`` counts as white
space); blocks are joined by a newline.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_name, ship

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: To the end of a tag; quotes only count right after an equals sign.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']*+)))?+""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_BLANK = re.compile(r"\s")
_SENTENCE = re.compile(r"[^\W\d_]{2}[.!?]['\"”’)]*\s*$")

#: Fixed values of the HTML standard: elements that stand in the flow of a line, those without an end tag, those whose content is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label map mark meter output picture progress q ruby rb rp rt s samp small source span strike strong sub sup time tt u var wbr nobr center math mi mo mn mrow msup msub mfrac".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style title textarea iframe noscript noembed noframes xmp".split()}
#: Elements whose text isn't shown, or is none of the page's.
SILENT = frozenset("head svg select template datalist object audio video canvas".split())
#: A start tag of the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("table ul ol dl article section main div body html td th".split())
#: Inline elements that are nodes of their own even without a cue.
CONTROLS = frozenset("button label output meter progress".split())
#: Tags that say what an element is.
TELLING = frozenset("nav header footer aside main article form fieldset dialog menu address button label h1 h2".split())
WRAPPERS = frozenset("div section table tbody tr td center form span font".split())
#: Words in class, id, role, aria-label and itemprop that are cues, by what they tell.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip topbar sitemap",
    "edge": "header footer masthead colophon copyright legal bottom top contentinfo",
    "side": "sidebar aside side rail widget widgets complementary",
    "more": "related recommended recommendations recirc trending popular more tags categories",
    "advert": "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted outbrain taboola dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall login banner dialog toast",
    "social": "share sharing social follow like tweet",
    "talk": "comment comments commentlist reply replies discussion disqus respond reviews thread",
    "form": "form search contact",
    "main": "content article main post entry story body text page single maincontent articlebody blog prose markdown",
    "byline": "byline meta author date dateline",
}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
#: After these a word tells what the element has around or in it, not what it is.
_ABOUT = frozenset("has with without no is".split())
#: Elements that are nested deeper become siblings, as in browsers.
DEEPEST = 512
_NAMED = frozenset(("class", "id", "role", "aria-label", "itemprop"))
_WORTH = re.compile(r"class|id|role|aria|item|hidden|style|\by\b", re.I)


def _cues_of(value: str) -> frozenset:
    found, before = set(), ""
    for w in _PART.findall(value):
        w = w.lower()
        if w in _CUE and before not in _ABOUT:
            found.add(_CUE[w])
        before = w
    return frozenset(found)


_cached_cues = lru_cache(1 << 14)(_cues_of)


def _attributes(raw: str) -> tuple[frozenset, bool, str | None]:
    """Cues, whether the element is hidden, and the label ``y`` of training pages."""
    if not _WORTH.search(raw):
        return frozenset(), False, None
    cues, hidden, y = frozenset(), False, None
    for name, *values in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), "".join(values)
        if name in _NAMED:
            cues |= _cached_cues(value) if len(value) < 200 else _cues_of(value)  # only what is cached is bounded
        elif name == "y":
            y = value
        elif name == "hidden":
            hidden = value.lower() != "until-found"
        elif name == "style":
            shown = _SPACE.sub("", value).lower()
            hidden = hidden or "display:none" in shown or "visibility:hidden" in shown
    return cues, hidden, y


class Forest:
    """Elements of pages, parents before children. The root of a page has no tag; parent is -1 there."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.cues: list[frozenset] = []
        self.y: list[str | None] = []
        self.own: list[int] = []  # characters that aren't white space
        self.links: list[int] = []  # those in links
        self.sentences: list[int] = []

    def add(self, tag: str, parent: int, cues: frozenset = frozenset(), y: str | None = None) -> int:
        if parent >= 0 and self.depth[parent] >= DEEPEST:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.cues.append(cues)
        self.y.append(y)
        self.own.append(0)
        self.links.append(0)
        self.sentences.append(0)
        return len(self.tag) - 1

    def parse(self, page: str) -> list[list[tuple[int, str]]]:
        """Adds the page; returns its blocks in page order: pieces of (node, text)."""
        here = self.add("", -1)
        stack: list[tuple[str, int, bool, bool]] = []  # tag, node to return to, whether it is a block, whether it is silent
        count: Counter[str] = Counter()
        blocks: list[list[tuple[int, str]]] = []
        pieces: list[tuple[int, str]] = []
        silent, at = 0, 0

        def flush() -> None:
            nonlocal pieces
            if pieces:
                blocks.append(pieces)
                pieces = []

        def text(piece: str) -> None:
            if silent or not piece:
                return
            piece = html.unescape(piece) if "&" in piece else piece
            n = len(piece) - len(_BLANK.findall(piece))
            pieces.append((here, piece))
            if n:
                self.own[here] += n
                if count["a"]:
                    self.links[here] += n
                elif _SENTENCE.search(piece):
                    self.sentences[here] += 1

        def pop() -> None:
            nonlocal here, silent
            tag, back, block, quiet = stack.pop()
            count[tag] -= 1
            if block:
                flush()
            here = back
            silent -= quiet

        while True:
            lt = page.find("<", at)
            if lt < 0:
                text(page[at:])
                break
            follow = page[lt + 1 : lt + 2]
            if not (follow.isascii() and follow.isalpha()) and follow not in ("/", "!", "?"):
                text(page[at : lt + 1])
                at = lt + 1
                continue
            text(page[at:lt])
            if follow in ("!", "?"):
                comment = page.startswith("<!--", lt)
                end = page.find("-->", lt + 2) if comment else page.find(">", lt)
                if end < 0:
                    break
                at = end + (3 if comment else 1)
                continue
            closing = follow == "/"
            name = _NAME.match(page, lt + 1 + closing)
            if name is None:
                end = page.find(">", lt)
                if end < 0:
                    break
                at = end + 1
                continue
            rest = _REST.match(page, name.end())
            if rest is None:  # no end of the tag
                break
            at, tag = rest.end(), name[0].lower()
            if closing:
                if count[tag]:
                    if tag in INLINE:
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] == tag:
                                while len(stack) > k:
                                    pop()
                                break
                            if stack[k][2]:
                                break
                    else:
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                elif tag not in INLINE:
                    flush()
                continue
            raw = page[name.end() : at - 1]
            if tag in RAW:
                end = RAW[tag].search(page, at)
                if end is None:
                    break
                rest = _REST.match(page, end.end())
                if rest is None:
                    break
                at = rest.end()
                continue
            if tag in ("html", "body"):
                continue
            if tag in VOID:
                if tag == "br":
                    text(" ")
                elif tag not in INLINE:
                    flush()
                if tag == "hr" and count["p"]:
                    self._end_p(stack, pop)
                continue
            block = tag not in INLINE
            if block:
                flush()
                if tag in ENDS_P and count["p"]:
                    self._end_p(stack, pop)
                out = ENDS.get(tag)
                if out and any(count[t] for t in out):
                    k = len(stack) - 1
                    while k >= 0 and (stack[k][0] in out or stack[k][0] not in SCOPE or tag == "tr" and stack[k][0] in ("td", "th")):
                        k -= 1
                    last = [j for j in range(k + 1, len(stack)) if stack[j][0] in out]
                    while last and len(stack) > last[0]:
                        pop()
            elif tag == "a" and count["a"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "a":
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][2]:
                        break
            cues, hidden, y = _attributes(raw)
            quiet = hidden or tag in SILENT
            if raw.endswith("/") and "=" not in raw.rsplit(" ", 1)[-1]:
                continue
            shown = not (quiet or silent)
            node = self.add(tag, here, cues, y) if shown and (block or cues or tag in CONTROLS) else here
            stack.append((tag, here, block, quiet))
            count[tag] += 1
            here = node
            silent += quiet
        while stack:
            pop()
        flush()
        return blocks

    @staticmethod
    def _end_p(stack: list[tuple[str, int, bool, bool]], pop) -> None:
        """Close an open p, unless another element that holds blocks is open inside it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "p":
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in SCOPE:
                return


class Tree:
    """The forest as arrays: features, edge types and levels."""

    def __init__(self, forest: Forest, known: dict[str, int], grow: bool = False):
        def number(name: str) -> int:
            if grow:
                return known.setdefault(name, len(known))
            return known.get(name, -1)

        n = self.n = len(forest.tag)
        self.parent, depth = np.array(forest.parent, np.int64), np.array(forest.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        own, links, sentences = (np.array(x, np.float64) for x in (forest.own, forest.links, forest.sentences))
        total, linked, ended = own.copy(), links.copy(), sentences.copy()
        paragraphs = np.array([float(t == "p" and n > 0) for t, n in zip(forest.tag, forest.own, strict=True)])
        headings = np.array([float(t in ("h1", "article", "main")) for t in forest.tag])
        for level in self.levels[:0:-1]:
            for x in (total, linked, ended, paragraphs, headings):
                np.add.at(x, self.parent[level], x[level])
        size = np.searchsorted([1, 25, 100, 400], total, "right")
        share = np.where(total > 0, np.minimum(3, 4 * linked / np.maximum(total, 1)), 0).astype(int)
        inner = self.parent >= 0
        node, feature = [], []

        def feed(names: list[str], which: np.ndarray) -> None:
            ids = np.array([number(x) for x in names], np.int64)
            node.append(np.flatnonzero(inner))
            feature.append(ids[which[inner]])

        feed([f"size {k}" for k in range(5)], size)
        feed([f"links {s} of {k}" for s in range(4) for k in range(3)], share * 3 + np.minimum(size, 2))
        feed(["no sentence", "a sentence", "sentences"], np.minimum(ended, 2).astype(int))
        feed(["no p", "a p", "few p", "many p"], np.searchsorted([1, 2, 5], paragraphs, "right"))
        feed(["no title", "a title"], np.minimum(headings, 1).astype(int))
        tags = [number(f"tag {t}") for t in forest.tag]
        node.append(np.flatnonzero(inner))
        feature.append(np.array(tags, np.int64)[inner])
        marked = [(i, number(f"cue {c}")) for i, cues in enumerate(forest.cues) for c in cues]
        node.append(np.array([x[0] for x in marked], np.int64))
        feature.append(np.array([x[1] for x in marked], np.int64))
        self.node, self.feature = np.concatenate(node), np.concatenate(feature)
        seen = self.feature >= 0
        self.node, self.feature = self.node[seen], self.feature[seen]
        bare = np.array([p < 0 or not c and t in WRAPPERS for p, c, t in zip(forest.parent, forest.cues, forest.tag, strict=True)]) & (own == 0)
        told = np.array([bool(c) or t in TELLING for c, t in zip(forest.cues, forest.tag, strict=True)], bool)
        self.edge = told.astype(int) + 2 * bare[self.parent]

    def marginals(self, weights: np.ndarray, edges: np.ndarray, clamp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content of each node, and of the pairs (parent, child) of states of its edge. clamp: state or -1 by node."""
        own = np.bincount(self.node, weights[self.feature], self.n)
        belief = np.stack([np.zeros(self.n), own], 1)
        if clamp is not None:
            belief[clamp == 0, 1] -= 1e6
            belief[clamp == 1, 0] -= 1e6
        up = np.zeros((self.n, 2))
        pair = np.zeros((self.n, 2, 2))
        for level in self.levels[:0:-1]:
            e = edges[self.edge[level]]
            up[level] = np.logaddexp(e[:, :, 0] + belief[level, :1], e[:, :, 1] + belief[level, 1:])
            np.add.at(belief, self.parent[level], up[level])
        for level in self.levels[1:]:
            joint = edges[self.edge[level]] + (belief[self.parent[level]] - up[level])[:, :, None] + belief[level][:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            pair[level] = joint / joint.sum((1, 2), keepdims=True)
            belief[level] = np.log(np.maximum(pair[level].sum(1), 1e-300))
        root = self.levels[0]
        belief[root] -= np.logaddexp(belief[root, 0], belief[root, 1])[:, None]
        return np.exp(belief[:, 1]), pair


@cache
def model() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Numbers of the features, their weights, and the edge potentials [type, parent, child], fitted to the labelled pages."""
    from .html_training import labelled_pages

    forest, known = Forest(), {}
    for page in labelled_pages():
        forest.parse(page)
    label = np.full(len(forest.tag), -1)
    for i, (y, p) in enumerate(zip(forest.y, forest.parent, strict=True)):
        label[i] = int(y) if y is not None else label[p] if p >= 0 else -1
    tree = Tree(forest, known, grow=True)
    inner = tree.parent >= 0
    w, e = np.zeros(len(known)), np.zeros((4, 2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(e), np.zeros_like(e)]
    for step in range(1, 201):  # Adam on the log-likelihood, with a Gaussian prior
        want, want_pair = tree.marginals(w, e, label)
        have, have_pair = tree.marginals(w, e)
        gw = np.bincount(tree.feature, (want - have)[tree.node], len(w)) - 0.5 * w
        ge = np.zeros_like(e)
        np.add.at(ge, tree.edge[inner], (want_pair - have_pair)[inner])
        ge -= 0.5 * e
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (e, ge, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return known, w, e


def main_texts(pages: list[str | None], fitted: tuple[dict[str, int], np.ndarray, np.ndarray] | None = None) -> list[str]:
    """Main text of each page."""
    known, weights, edges = fitted or model()
    forest = Forest()
    blocks = [forest.parse(p) if p else [] for p in pages]
    if not forest.tag:
        return [""] * len(pages)
    content = (Tree(forest, known).marginals(weights, edges)[0] >= 0.5).tolist()
    texts = []
    for found in blocks:
        lines = (_SPACE.sub(" ", "".join(piece for node, piece in block if content[node])).strip() for block in found)
        texts.append("\n".join(x for x in lines if x))
    return texts


def main_text(page: str | None) -> str:
    return main_texts([page])[0]


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", batch_chars: int = 1 << 21) -> DataFrame:
    """The rows with the main text of the page (null: empty). Pages of about batch_chars together share the message passing."""
    ship(pages.sparkSession)
    name, columns = free_name(pages, out), list(pages.columns)
    fitted = model()

    def texts(batches):
        for b in batches:
            found, held, size = [], [], 0
            for x in b.column(html_col).to_pylist():
                held.append(x)
                size += len(x or "")
                if size >= batch_chars:
                    found += main_texts(held, fitted)
                    held, size = [], 0
            found += main_texts(held, fitted)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(found, pa.string())], [*columns, name])

    return pages.mapInArrow(texts, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), f"`{name}` string"]))

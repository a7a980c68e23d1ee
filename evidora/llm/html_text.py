"""Main text of web pages by a tree-structured graphical model.

The nodes of the model are a page's block elements that hold text and, below
them, its text blocks.  A node is main (all of its text is main text), other (none
of it is) or mixed.  A node's own potential is log-linear in its features: tag,
class and id tokens, length, share of the page and of linked text, how often it is
repeated among its siblings, what stands before it and around it, and where in the page it is.  A potential between
parent and child says which states go together.  Both are learnt from labelled
pages; no list of words is written down.  The model is a tree, so one pass of
sum-product messages up and one down give exact marginals, and the blocks that are
more likely main than not are the text: a menu's links are known by the menu around
them, and an article by its paragraphs.

Pages are parsed as browsers do where it matters: elements that end by
implication, void elements, raw text of scripts and styles, character references.
The parser looks at every character a bounded number of times, whatever the page.

Cases: null and empty html, and pages without a main block, have empty text;
text is taken from every block, however long; a page of any length is parsed
whole; unclosed and stray tags never fail; a block that is as likely main as not
is left out; rows that repeat are each extracted, and alike; null ids and URLs are
carried along; extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidora.llm.html_pages import labelled_pages

MAIN, OTHER, MIXED = range(3)
AT_ONCE = 20000       # nodes of pages that are judged together, about
EPOCHS, RATE, RIDGE = 400, 0.05, 2e-6

NAME = re.compile(r"/?([a-zA-Z][\w:-]*+)")
MARK = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"(?<![\w:-])([\w:-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements without text of the page, and those of them that swallow the rest of the page where they are not ended.
RAW = frozenset("script style noscript template iframe svg select textarea button title object".split())
GREEDY = frozenset(("script", "style", "textarea", "title"))
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav "
                   "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset(("html", "body", "caption", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "figcaption"))
LANDMARKS = frozenset("article main nav aside header footer form dialog section".split())
# Elements that end when one of the others begins, and the elements that they are looked for in.
ENDED_BY = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
            "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
            "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))}


class Node:
    __slots__ = ("tag", "parent", "words", "label", "text", "linked", "length", "start", "long", "children", "like", "within", "after", "next", "last")

    def __init__(self, tag, parent, words="", label=None, start=0):
        self.tag, self.parent, self.words, self.label, self.start = tag, parent, words, label, start
        self.text, self.linked, self.length, self.long, self.children, self.like = None, 0, 0, 0, 0, 1
        self.within, self.after, self.next, self.last = "", "", "", None  # nearest landmark around, tags of the siblings before and after, last child


class _Scanner:
    """Text, start and end tags of a page, in order."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.unended: set[str] = set()  # what has no end in the rest of the page

    def find(self, what: str, at: int) -> int:
        if what in self.unended:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.unended.add(what)
        return found

    def tag_end(self, start: int) -> int:
        """Where the tag's > is: quotes hide it in values; where a quote has no end, quotes no longer count."""
        page, at = self.page, start
        while m := MARK.search(page, at):
            c, at = m[0], m.end()
            if c == ">":
                return m.start()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if self.quotes and page[before] == "=":
                close = self.find(c, at)
                if close < 0:
                    self.quotes, at = False, start
                else:
                    at = close + 1
        return -1

    def __iter__(self):
        """("text", text, "") or (kind, tag, attributes) with kind "start" or "end"."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                yield "text", page[at:], ""
                return
            if lt > at:
                yield "text", page[at:lt], ""
            m = NAME.match(page, lt + 1)
            if m is None:
                if page.startswith("<!--", lt):
                    end = self.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                elif page[lt + 1:lt + 2] in ("!", "?"):
                    end = self.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    yield "text", "<", ""
                    at = lt + 1
                continue
            end = self.tag_end(m.end())
            if end < 0:  # the page ends in a tag
                return
            tag, ends, at = m[1].lower(), page[lt + 1] == "/", end + 1
            if tag in RAW:
                if not ends and page[end - 1] != "/":
                    stop = None if tag in self.unended else re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                    if stop:
                        at = stop.end()
                    elif tag in GREEDY:
                        return
                    else:
                        self.unended.add(tag)
                continue
            yield "end" if ends else "start", tag, page[m.end():end]


def parse(page: str) -> list[Node]:
    """Nodes in page order, the first the root; text blocks have ``text`` and the tag ``#``.  Elements without text are left out."""
    root = Node("html", None)
    nodes: list[Node] = [root]
    stack: list[tuple[str, Node | None]] = [("html", root)]  # open elements; inline ones have no node
    places: dict[str, list[int]] = defaultdict(list)         # of each tag in the stack
    blocks = [0]                                             # places of block elements in the stack
    parts: list[str] = []
    linked = seen = 0
    in_head = False

    def flush():
        nonlocal parts, linked, seen
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node = Node("#", stack[blocks[-1]][1], start=seen)
                node.text, node.length, node.linked, node.long = text, len(text), min(linked, len(text)), int(len(text) > 80)
                nodes.append(node)
                seen += len(text)
            parts, linked = [], 0

    def pop_to(i):
        for tag, node in stack[i:]:
            places[tag].pop()
            if node is not None:
                blocks.pop()
        del stack[i:]

    def last(tag):
        return places[tag][-1] if places.get(tag) else 0

    for kind, tag, rest in _Scanner(page):
        if kind == "text":
            if not in_head:
                text = html.unescape(tag)
                parts.append(text)
                linked += len(text) if places.get("a") else 0
            continue
        end = kind == "end"
        if tag in ("html", "body", "head"):
            in_head = tag == "head" and not end
            flush()
            if tag == "body" and not end and rest:
                root.words, root.label = _words(rest), _label(rest)
            continue
        if in_head and tag in BLOCKS:
            in_head = False
        if end:
            at = last(tag)
            if at and tag in BLOCKS:
                flush()
                pop_to(at)
            elif at and blocks[-1] < at:  # an inline end tag does not close blocks
                pop_to(at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag not in BLOCKS:
            if not rest.endswith("/"):
                places[tag].append(len(stack))
                stack.append((tag, None))
            continue
        if tag in CLOSES_P and last("p") and last("p") == blocks[-1]:
            flush()
            pop_to(last("p"))
        if tag in ENDED_BY:
            ended, within = ENDED_BY[tag]
            limit = max(map(last, within))
            above = [p[i] for p in map(places.__getitem__, ended) if (i := bisect_right(p, limit)) < len(p)]
            if above:
                flush()
                pop_to(min(above))
        flush()
        if tag == "hr":
            continue
        node = Node(tag, stack[blocks[-1]][1], _words(rest) if rest else "", _label(rest), seen)
        nodes.append(node)
        blocks.append(len(stack))
        places[tag].append(len(stack))
        stack.append((tag, node))
    flush()
    for node in reversed(nodes):
        if node.parent is not None:
            up = node.parent
            up.length += node.length
            up.linked += node.linked
            up.long += node.long
    nodes = [n for n in nodes if n.length or n.parent is None]
    alike: dict[tuple, int] = defaultdict(int)
    for n in nodes[1:]:
        n.parent.children += 1
        alike[id(n.parent), n.tag, n.words] += 1
    for n in nodes[1:]:
        n.like = alike[id(n.parent), n.tag, n.words]
        n.within = n.parent.tag if n.parent.tag in LANDMARKS else n.parent.within
        if n.parent.last is not None:
            n.after, n.parent.last.next = n.parent.last.tag, n.tag
        n.parent.last = n
    return nodes


def _words(attributes: str) -> str:
    out = []
    for a in ATTRIBUTE.finditer(attributes):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            out.append(value)
        elif key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            out.append("hidden")
    if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
        out.append("hidden")
    return " ".join(out)


def _label(attributes: str):
    m = re.search(r'data-main="([01])"', attributes) if attributes and "data-main" in attributes else None
    return int(m[1]) if m else None


def _grade(n: int, *steps: int) -> int:
    return sum(n >= x for x in steps)


def features(node: Node, total: int) -> list[str]:
    """What is seen of a node in a page with ``total`` characters of text."""
    up = node.parent.tag if node.parent is not None else ""
    links = int(4 * node.linked / node.length) if node.length else 0
    place = int(5 * node.start / (total + 1))
    if node.text is not None:
        size = _grade(node.length, 12, 25, 50, 100, 200, 400)
        stop = node.text[-1] in ".!?:;\"'»”…"
        return [f"# {up}", f"# size {size} {stop}", f"# links {links}", f"# place {place} {node.parent.children > 1}", f"# mark {'©' in node.text}", f"# only {up} {size} {links > 1}", f"# within {node.within} {up}", f"# within {node.within} {links > 1}"]
    size = _grade(node.length, 25, 100, 300, 1000, 3000)
    whole = int(4 * node.length / (total + 1))
    out = [f"tag {node.tag}", f"tag {node.tag} {whole > 1} {links > 1}", f"size {size}", f"whole {whole} {links > 1}", f"links {links}", f"long {_grade(node.long, 1, 2, 4, 8)} {whole}",
           f"like {_grade(node.like, 2, 3, 5)} {links > 1}", f"place {place}", f"in {up} {node.tag}", f"within {node.within} {node.tag} {links > 1}", f"within {node.within} {node.tag} after {node.after}", f"{node.tag} between {node.after} {node.next}"]
    words = {t.lower() for t in TOKENS.findall(node.words)}
    for w in words:
        out += [f"word {w}", f"word {w} {node.tag} {whole > 1}", f"word {w} {len(words) > 2}"]
    return out


class Forest:
    """The nodes of some pages as arrays: parents, levels from the roots down, and which nodes are text blocks."""

    def __init__(self, pages: list[list[Node]]):
        at: dict[int, int] = {}
        depth: list[int] = []
        parent: list[int] = []
        for nodes in pages:
            for n in nodes:  # parents stand before their children
                up = -1 if n.parent is None else at[id(n.parent)]
                at[id(n)] = len(parent)
                parent.append(up)
                depth.append(0 if up < 0 else depth[up] + 1)
        self.parent = np.array(parent, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(np.array(depth, np.int64)[order])) + 1) if len(order) else []
        self.text = np.array([n.text is not None for nodes in pages for n in nodes], bool)
        self.size = len(parent)

    def marginals(self, own: np.ndarray, pair: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """P(state) of every node by sum-product messages up and down; own potentials, pairs and prior are logarithms."""
        belief = own.copy()
        belief[self.text, MIXED] = -1e30  # a text block is one or the other
        up = np.zeros_like(own)
        for level in self.levels[:0:-1]:
            up[level] = _log_sum(belief[level][:, None, :] + pair, 2)
            np.add.at(belief, self.parent[level], up[level])
        whole = belief
        for i, level in enumerate(self.levels):
            above = prior if i == 0 else _log_sum((whole[self.parent[level]] - up[level])[:, :, None] + pair, 1)
            w = belief[level] + above
            whole[level] = w - w.max(1, keepdims=True)
        p = np.exp(whole)
        return p / p.sum(1, keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class TreeModel:
    """Weights of features for each state, and the potentials of parent and child states."""

    def __init__(self, pages: list[str] | None = None):
        parsed = [parse(p) for p in (labelled_pages() if pages is None else pages)]
        labels = [self.states(nodes) for nodes in parsed]
        pair, prior = np.full((3, 3), 1e-3), np.ones(3)
        seen: dict[str, int] = defaultdict(int)
        for nodes, state in zip(parsed, labels, strict=True):
            of = {id(n): s for n, s in zip(nodes, state, strict=True)}
            for n, s in zip(nodes, state, strict=True):
                if n.parent is None:
                    prior[s] += 1
                else:
                    pair[of[id(n.parent)], s] += 1
                for f in features(n, nodes[0].length):
                    seen[f] += 1
        self.index = {f: i for i, f in enumerate(f for f, n in seen.items() if n > 2)}
        self.prior, self.pair = np.log(prior / prior.sum()), np.log(pair / pair.sum(1, keepdims=True))
        states = np.array([s for state in labels for s in state], int)
        self.share = np.log((np.bincount(states, minlength=3) + 1.0) / (len(states) + 3))
        self._fit(parsed, states)

    def _fit(self, parsed: list[list[Node]], states: np.ndarray) -> None:
        """A multinomial logistic regression of the states by gradient steps with momentum (Adam).

        It is fitted to each node by itself, so that no node relies on its neighbours' features: the messages add what these say.
        """
        of, feature = self._known(parsed)
        want, n = np.eye(3)[states], len(self.index)
        w, m, v = np.zeros((n, 3)), np.zeros((n, 3)), np.zeros((n, 3))
        for step in range(1, EPOCHS + 1):
            z = self._sums(w, of, feature, len(states))
            p = np.exp(z - z.max(1, keepdims=True))
            d = p / p.sum(1, keepdims=True) - want
            g = np.stack([np.bincount(feature, d[of, s], n) for s in range(3)], 1) / max(len(states), 1) + RIDGE * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = w

    @staticmethod
    def states(nodes: list[Node]) -> list[int]:
        """States of a labelled page: those of text blocks from the nearest label, and of elements from the blocks in them."""
        has: dict[int, set] = defaultdict(set)
        for node in nodes:
            if node.text is not None:
                up = node
                while up.parent is not None and up.label is None:
                    up = up.parent
                mine = MAIN if up.label == 1 else OTHER
                while node is not None:
                    has[id(node)].add(mine)
                    node = node.parent
        return [MIXED if len(has[id(n)]) > 1 else next(iter(has[id(n)]), OTHER) for n in nodes]

    def _known(self, pages: list[list[Node]]) -> tuple[np.ndarray, np.ndarray]:
        """(node, feature) for all features that the model has a weight for; others say nothing."""
        index, of, feature, i = self.index, [], [], 0
        for nodes in pages:
            total = nodes[0].length
            for n in nodes:
                known = [x for f in features(n, total) if (x := index.get(f)) is not None]
                feature += known
                of += [i] * len(known)
                i += 1
        return np.array(of, np.int64), np.array(feature, np.int64)

    @staticmethod
    def _sums(weights: np.ndarray, of: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(of, weights[feature, s], n) for s in range(3)], 1)

    def marginals(self, pages: list[list[Node]], messages: bool = True) -> np.ndarray:
        """P(main) of every node of some pages; without messages from its own potential alone."""
        forest = Forest(pages)
        z = self._sums(self.weights, *self._known(pages), forest.size)
        if not messages:
            z[forest.text, MIXED] = -1e30
            p = np.exp(z - z.max(1, keepdims=True))
            return (p / p.sum(1, keepdims=True))[:, MAIN]
        own = z - self.share  # log P(features | state), but for a constant
        return forest.marginals(own, self.pair, self.prior)[:, MAIN]

    def extract_all(self, pages: list[str | None]) -> list[str]:
        """Main text of each page; pages are parsed and judged together, ``AT_ONCE`` nodes at a time."""
        out, held, size = [], [], 0
        for i, page in enumerate(pages):
            held.append(parse(page or ""))
            size += len(held[-1])
            if size >= AT_ONCE or i == len(pages) - 1:
                main = (self.marginals(held) > 0.5).tolist()
                at = 0
                for nodes in held:
                    out.append("\n".join(n.text for n, x in zip(nodes, main[at:at + len(nodes)], strict=True) if x and n.text is not None))
                    at += len(nodes)
                held, size = [], 0
        return out

    def extract(self, page: str | None) -> str:
        return self.extract_all([page])[0]


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or TreeModel())  # a few thousand numbers

    def run(batches):
        for b in batches:
            texts = shared.value.extract_all(b.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))

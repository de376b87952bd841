"""Main-text extraction by a tree-structured graphical model over the DOM.

Each block element of a page is a node with a binary label, content or not. Node potentials
come from its tag, class and id words, text and links; parent-child potentials tie the labels
of neighbours in the tree. As the graph is a tree, one upward and one downward pass of
sum-product messages give exact marginals, both for training (gradient: observed minus
expected statistics over labelled pages) and for extraction (marginal over one half).
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, of raw text, without readable text, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SILENT = frozenset("head script style title textarea template noscript noembed noframes iframe svg canvas audio video select option button input datalist map xmp".split())
INLINE = frozenset("math mi mn mo mrow msup msub mfrac mtext msqrt object a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[\s\x00]+")
BUCKETS = 8192
#: Ancestors whose names are features of a node, and elements that count as names.
ANCESTORS = 5
TELLING = frozenset("article aside footer form header main nav".split())
MAX_LABELLED_NODES = 200_000


class Node:
    """A block element: parent index, tag, words of class, id and role, pieces of own text, characters of it and of its links."""

    __slots__ = ("parent", "tag", "words", "pieces", "chars", "linked", "hidden", "label")

    def __init__(self, parent: int, tag: str, attributes: dict[str, str]) -> None:
        self.parent, self.tag = parent, tag
        said = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop"))
        self.words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower())
        style = attributes.get("style", "").replace(" ", "").lower()
        self.hidden = "hidden" in attributes or "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden") == "true"
        self.label = attributes.get("data-label")
        self.pieces: list[tuple[int, str]] = []
        self.chars = self.linked = 0


def attributes_of(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text else {}


def parse(page: str) -> list[Node]:
    """Block elements of a page, parents first; text pieces carry a running number, so page order can be restored.

    Tolerant: unclosed and misnested tags, raw-text elements and a page cut anywhere are fine;
    a tag that the end of the page cuts off is dropped.
    """
    nodes = [Node(-1, "body", {})]
    stack: list[tuple[str, int]] = [("body", 0)]  # open tags with the block node that holds their text
    silent = links = order = at = 0
    held: dict[str, int] = {}  # open tags by name

    def text(raw: str) -> None:
        nonlocal order
        if silent or not raw:
            return
        plain = SPACE.sub(" ", html.unescape(raw))
        node = nodes[stack[-1][1]]
        node.pieces.append((order, plain))
        order += 1
        size = len(plain.strip())
        node.chars += size
        if links:
            node.linked += size

    def pop_to(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            tag, _ = stack.pop()
            held[tag] -= 1
            silent -= tag in SILENT
            links -= tag == "a"

    def close(names: set[str], stops: set[str] | frozenset[str]) -> None:
        if not any(map(held.get, names)):
            return  # so tags without a partner cost nothing, however many are open
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                pop_to(i)
                return
            if stack[i][0] in stops:
                return

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                text(" ")
            elif tag not in ("html", "body"):
                close({tag}, {"article", "main", "table"} - {tag} if tag in INLINE or tag == "p" else frozenset())
            continue
        if not m[2] or not m[4]:
            continue
        tag = m[2].lower()
        if tag in ("br", "wbr", "hr", "img"):
            text(" " if tag != "wbr" else "")
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "body", "blockquote"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], SCOPE.get(tag, set()))
        if tag in ("html", "body"):
            pop_to(1)  # an unclosed head ends here
            nodes[0].label = attributes_of(m[3]).get("data-label", nodes[0].label)
            continue
        holder = stack[-1][1]
        if tag not in INLINE:
            nodes.append(Node(holder, tag, attributes_of(m[3])))
            holder = len(nodes) - 1
        elif m[3]:
            given = attributes_of(m[3])
            if "style" in given or "hidden" in given or "aria-hidden" in given:
                probe = Node(holder, tag, given)
                if probe.hidden:
                    nodes.append(probe)
                    holder = len(nodes) - 1
        stack.append((tag, holder))
        held[tag] = held.get(tag, 0) + 1
        silent += tag in SILENT
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
    rest = page[at:]
    text(rest)
    return nodes


def node_features(nodes: Sequence[Node]) -> list[list[int]]:
    """Hashed features of each node."""
    kids = [0] * len(nodes)
    below, below_linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        kids[p] += 1
        below[p] += below[i]
        below_linked[p] += below_linked[i]
    named = [{*n.words, *([f"<{n.tag}>"] if n.tag in TELLING else [])} for n in nodes]
    out = []
    for i, n in enumerate(nodes):
        share = n.linked / n.chars if n.chars else 0
        tree = below_linked[i] / below[i] if below[i] else 0
        names = ["bias", f"tag={n.tag}", f"in={nodes[n.parent].tag if n.parent >= 0 else ''}", f"link={int(share * 3.99)}", f"tree={int(tree * 3.99)}", f"chars={min(6, len(bin(n.chars // 10)) - 2)}"]
        names += [f"big={min(8, len(bin(below[i] // 50)) - 2)}", f"kids={min(4, kids[i])}", f"prose={n.chars >= 60 and share < 0.75}", f"own={n.tag}{n.chars > 0}{n.parent < 0}", f"pair={n.tag},{nodes[n.parent].tag if n.parent >= 0 else ''}"]
        names += [f"word={w}" for w in set(n.words)]
        up, above = n.parent, set()
        for _ in range(ANCESTORS):
            if up < 0:
                break
            above |= named[up]
            up = nodes[up].parent
        names += [f"under={w}" for w in above]
        if n.hidden:
            names.append("hidden")
        if n.pieces and n.chars:
            last = next((t.rstrip()[-1:] for _, t in reversed(n.pieces) if t.strip()), "")
            names.append(f"stop={last in '.!?:;'}")
        out.append(sorted({_bucket(x) for x in names}))
    return out


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


class Forest:
    """Trees of many pages, laid out by depth for vectorised sum-product."""

    def __init__(self, pages: Sequence[Sequence[Node]]) -> None:
        parent, depth, rows, cols, self.starts = [], [], [], [], [0]
        for nodes in pages:
            base = len(parent)
            for i, found in enumerate(node_features(nodes)):
                p = nodes[i].parent
                parent.append(base + p if p >= 0 else -1)
                depth.append(depth[base + p] + 1 if p >= 0 else 0)
                rows += [base + i] * len(found)
                cols += found
            self.starts.append(len(parent))
        self.parent, depth = np.array(parent, np.int64), np.array(depth, np.int64)
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        self.levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if len(parent) else []
        self.tie = np.array([kind_of(n.tag) for nodes in pages for n in nodes], np.int64)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """Log potential of label 1 against 0 of each node."""
        return np.bincount(self.rows, weights[self.cols], len(self.parent))

    def marginals(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of label 1, joint marginal [n, parent label, own label]) of each node by sum-product.

        ties[kind, a, b] is the log potential of a parent labelled a with a child labelled b.
        """
        n = len(self.parent)
        own = np.stack([np.zeros(n), self.unary(weights)], axis=1)
        up = own.copy()  # own potential and all messages from children
        message = np.zeros((n, 2))  # to the parent
        for level in self.levels[:0:-1]:
            message[level] = np.logaddexp.reduce(ties[self.tie[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], message[level])
        down = np.zeros((n, 2))  # from the parent
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = up[p] + down[p] - message[level]
            down[level] = np.logaddexp.reduce(ties[self.tie[level]] + rest[:, :, None], axis=1)
        belief = up + down
        one = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = up[p] + down[p] - message[level]
            full = ties[self.tie[level]] + rest[:, :, None] + up[level][:, None, :]
            full -= full.max(axis=(1, 2), keepdims=True)
            full = np.exp(full)
            joint[level] = full / full.sum(axis=(1, 2), keepdims=True)
        return one, joint


KINDS = ("p", "list", "heading", "part", "other")


def kind_of(tag: str) -> int:
    """Kind of a child for its parent-child potential."""
    if tag in ("p", "pre", "blockquote"):
        return 0
    if tag in ("ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody"):
        return 1
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption"):
        return 2
    return 3 if tag in ("header", "footer", "nav", "aside", "form", "section") else 4


def train(pages: Sequence[str], *, rounds: int = 200, rate: float = 0.05, penalty: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ties) from labelled pages, whose elements carry data-label="1" or "0" or inherit it from their parent.

    At most MAX_LABELLED_NODES nodes are used, the first ones; pages beyond are left out whole.
    """
    parsed, total = [], 0
    for page in pages:
        nodes = parse(page)
        total += len(nodes)
        if total > MAX_LABELLED_NODES:
            break
        parsed.append(nodes)
    label: list[int] = []
    for nodes in parsed:
        base = len(label)
        for n in nodes:
            label.append(int(n.label) if n.label in ("0", "1") else label[base + n.parent] if n.parent >= 0 else 0)
    forest, y = Forest(parsed), np.array(label)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (forest.tie[child], y[forest.parent[child]], y[child]), 1)
    w, ties = np.zeros(BUCKETS), np.zeros((len(KINDS), 2, 2))
    first, second, n = [np.zeros_like(w), np.zeros_like(ties)], [np.zeros_like(w), np.zeros_like(ties)], len(y)
    for k in range(1, rounds + 1):
        one, joint = forest.marginals(w, ties)
        expected = np.zeros_like(ties)
        np.add.at(expected, forest.tie[child], joint[child])
        slopes = [np.bincount(forest.cols, (y - one)[forest.rows], BUCKETS) / n - penalty * w, (seen - expected) / n - penalty * ties]
        moves = []
        for i, slope in enumerate(slopes):  # steps scaled by each weight's own slopes, so rare names move too
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            moves.append(rate / (1 - 0.9**k) * first[i] / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-7))
        w, ties = w + moves[0], ties + moves[1]
    return w, ties


def extract(pages: Sequence[str], model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> list[str]:
    """Main text of each page: blocks with a marginal over threshold, in page order, joined by a space."""
    parsed = [parse(p) for p in pages]
    forest = Forest(parsed)
    one, _ = forest.marginals(*model)
    out = []
    for k, nodes in enumerate(parsed):
        keep = one[forest.starts[k] : forest.starts[k + 1]] > threshold
        pieces = sorted((order, i, t) for i, n in enumerate(nodes) if keep[i] for order, t in n.pieces)
        text, last = [], None
        for _, i, t in pieces:
            if i != last:
                text.append(" ")
            text.append(t)
            last = i
        out.append(SPACE.sub(" ", "".join(text)).strip())
    return out


def extract_pages(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], *, threshold: float = 0.5, batch_chars: int = 2_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars. A null or empty page, or one without content, gives an empty text; repeated rows get a row each; pages count whole, in time in proportion to their length, however long; other columns are ignored, whatever their names; an empty table gives an empty result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            source = pdf["html"].fillna("")
            for _, part in pdf.groupby(source.str.len().cumsum() // batch_chars, sort=False):
                text = extract(part["html"].fillna("").tolist(), model, threshold)
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")

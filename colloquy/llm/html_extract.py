"""Main text of web pages by belief propagation on the tree of their elements.

Every element is a variable with two states, content or not. Its own potential says how well its tag,
attribute words, link share, text length and punctuation fit either state; an edge potential says how a
parent's state goes with a child's, by whether the child is sectioning, inline or other. On a tree the
sum-product algorithm is exact: messages go up from the leaves and down from the root, and their product
is each element's marginal. All potentials are counts (with add-one smoothing) from labelled pages.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches
from colloquy.llm.labelled_pages import labelled_pages

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
HIDDEN = set("script style noscript template iframe object svg math head title select textarea button option datalist canvas audio video map".split())
#: What may stand in a head; anything else ends it, closed or not.
HEAD_PARTS = set("base basefont bgsound head link meta noframes noscript script style template title".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the set, as browsers do.
_PARAGRAPH_ENDS = BLOCKS - {"body", "html"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SECTIONS = set("article aside body div footer form header main nav section table".split())


#: Characters of a run of text that may be a sentence, and what is too unlikely to be content on any page.
SENTENCE, IMPOSSIBLE = 40, 0.02
#: Weight of the features of blocks that are no sections.
BLOCK_WEIGHT = 0.5
#: Weight of the words of the heading that a section begins with.
HEAD_WEIGHT = 3.0


@dataclass
class Node:
    tag: str
    words: tuple[str, ...]
    parent: int
    pieces: list = field(default_factory=list)  # text runs and child numbers, in order
    label: int | None = None


class TreeBuilder(HTMLParser):
    """Elements of a page as a list in document order; forgiving about missing and stray end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", (), -1)]
        self.open = [0]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in tags:
                del self.open[depth:]
                return
            if tag in stop:
                return

    def _end_head(self, inside: bool) -> None:
        """Closes the head if it is the innermost open element, or with `inside` whatever is open in it."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag == "head":
                del self.open[depth:]
                return
            if not inside or tag not in HEAD_PARTS or tag == "template":
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" and len(self.nodes) > 1:
            return
        if tag not in HEAD_PARTS:
            self._end_head(tag == "body")
        if tag in _PARAGRAPH_ENDS:
            self._close({"p"}, SECTIONS | {"li", "td", "th", "blockquote"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES.get(tag, set()))
        words, label = [], None
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                words += _attribute_words(value)
            elif name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                words.append("hidden")
            elif name == "data-content":
                label = int(value == "1")
        parent = self.open[-1]
        self.nodes.append(Node(tag, tuple(words), parent, label=label))
        self.nodes[parent].pieces.append(len(self.nodes) - 1)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and len(self.open) > 1 and self.nodes[self.open[-1]].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                del self.open[depth:]
                return
            if tag not in SECTIONS and self.nodes[self.open[depth]].tag in SECTIONS:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head(False)
        self.nodes[self.open[-1]].pieces.append(data)


def _attribute_words(value: str) -> list[str]:
    out, word = [], ""
    for c in value:
        if c.isalnum() and not (c.isupper() and word and not word[-1].isupper()):
            word += c
        else:
            if word:
                out.append(word.lower().rstrip("0123456789"))
            word = c if c.isalnum() else ""
    return [w for w in [*out, word.lower().rstrip("0123456789")] if w]


def parse(html: str | None) -> list[Node]:
    builder = TreeBuilder()
    if html:
        builder.feed(html)
        builder.close()
    return builder.nodes


def _features(nodes: list[Node]) -> list[list[str]]:
    """Discrete features of every element, from its subtree in one pass from the leaves."""
    text, linked, stops, children = ([0] * len(nodes) for _ in range(4))
    heads: list[str | None] = [None] * len(nodes)  # the heading that an element begins with; "" if it begins otherwise
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        for piece in node.pieces if node.tag not in HIDDEN else ():
            if isinstance(piece, str):
                if piece.strip():
                    heads[i] = piece.strip()[:40] if node.tag in HEADINGS else ""
            else:
                heads[i] = heads[piece]
            if heads[i] is not None:
                break
        if node.tag in HEADINGS and heads[i] == "":
            heads[i] = None
        if node.tag not in HIDDEN:
            for piece in node.pieces:
                if isinstance(piece, str):
                    text[i] += len(piece.strip())
                    stops[i] += sum(piece.count(c) for c in ".,;!?。，")
                else:
                    children[i] += 1
            if node.tag == "a":
                linked[i] = text[i]
        if node.parent >= 0 and node.tag not in HIDDEN:
            p = node.parent
            text[p] += text[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
    out = []
    above: list[tuple[str, ...]] = []
    for i, node in enumerate(nodes):
        size = text[i]
        share = linked[i] / size if size else 0.0
        found = [f"tag={node.tag}"]
        found += [f"word={w}" for w in dict.fromkeys(node.words)]
        # Attribute words of the nearest three elements above that have any.
        parent = nodes[node.parent] if node.parent >= 0 else None
        kept = above[node.parent] if parent is not None else ()
        above.append((" ".join(parent.words), *kept)[:3] if parent is not None and parent.words else kept)
        if _edge(node) == "inline":
            # What an inline element is, its surroundings tell; a link is all link wherever it stands.
            out.append(found)
            continue
        found += [f"above={w}" for w in dict.fromkeys(" ".join(above[i]).split())]
        if node.tag in SECTIONS and heads[i]:
            found += [f"head={w}" for w in dict.fromkeys(heads[i].lower().split()[:3])]
        found.append(f"size={min(int(math.log2(size + 1)), 10) // 2}")
        found.append(f"links={0 if share < 0.1 else 1 if share < 0.4 else 2 if share < 0.8 else 3}")
        found.append(f"stops={min(int(40 * stops[i] / (size + 1)), 3)}")
        out.append(found)
    return out


def _edge(child: Node) -> str:
    return child.tag if child.tag in SECTIONS else "block" if child.tag in BLOCKS else "inline"


def feature_weight(feature: str, node: Node) -> float:
    """The features of a block say much the same; halving their weight leaves more to the edges. Headings tell most."""
    return HEAD_WEIGHT if feature.startswith("head=") else BLOCK_WEIGHT if _edge(node) == "block" else 1.0


@dataclass(frozen=True)
class PageModel:
    """Log potentials: prior of the root, of features by state, and of (edge kind, parent, child)."""

    root: tuple[float, float]
    seen: dict[str, tuple[float, float]]
    edges: dict[tuple[str, int, int], float]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every element, by messages up and down the tree."""
        n = len(nodes)
        own = [[0.0, 0.0] for _ in range(n)]
        for i, found in enumerate(_features(nodes)):
            for f in found:
                a, b = self.seen.get(f, (0.0, 0.0))
                weight = feature_weight(f, nodes[i])
                own[i][0] += weight * a
                own[i][1] += weight * b
        up = [[0.0, 0.0] for _ in range(n)]  # message of element i to its parent, by the parent's state
        gathered = [list(p) for p in own]
        for i in range(n - 1, 0, -1):
            kind = _edge(nodes[i])
            for s in (0, 1):
                up[i][s] = _log_sum(self.edges[kind, s, 0] + gathered[i][0], self.edges[kind, s, 1] + gathered[i][1])
            p = nodes[i].parent
            gathered[p][0] += up[i][0]
            gathered[p][1] += up[i][1]
        down = [[0.0, 0.0] for _ in range(n)]
        down[0] = list(self.root)
        out = [0.0] * n
        for i in range(n):
            if i:
                p, kind = nodes[i].parent, _edge(nodes[i])
                rest = [gathered[p][s] - up[i][s] + down[p][s] for s in (0, 1)]
                for s in (0, 1):
                    down[i][s] = _log_sum(rest[0] + self.edges[kind, 0, s], rest[1] + self.edges[kind, 1, s])
            odds = gathered[i][0] + down[i][0] - gathered[i][1] - down[i][1]
            out[i] = 1 / (1 + math.exp(min(max(odds, -700), 700)))
        return out


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[str], weight: float = 1.0) -> PageModel:
    """Counts from labelled pages: data-content="1" or "0" labels an element and, unless they have
    labels of their own, all below it; elements without any label above are no content."""
    feature: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    edge: dict[tuple[str, int, int], float] = defaultdict(float)
    total, root = [0.0, 0.0], [0.0, 0.0]
    for page in pages:
        nodes = parse(page)
        states = [0] * len(nodes)
        for i, node in enumerate(nodes):
            states[i] = node.label if node.label is not None else states[node.parent] if i else 0
            if i:
                edge[_edge(node), states[node.parent], states[i]] += weight
        root[states[0]] += 1
        for state, found in zip(states, _features(nodes)):
            total[state] += 1
            for f in found:
                feature[f][state] += 1
    families: dict[str, int] = defaultdict(int)
    for f in feature:
        families[f.split("=")[0]] += 1
    seen = {
        f: tuple(math.log((counts[s] + 0.5) / (total[s] + 0.5 * families[f.split("=")[0]])) for s in (0, 1))
        for f, counts in feature.items()
    }
    edges = {}
    for kind in SECTIONS | {"block", "inline"}:
        for s in (0, 1):
            row = [edge[kind, s, c] + 0.5 for c in (0, 1)]
            for c in (0, 1):
                edges[kind, s, c] = math.log(row[c] / sum(row))
    return PageModel(tuple(math.log((x + 0.5) / (sum(root) + 1)) for x in root), seen, edges)


def main_text(html: str | None, model: PageModel) -> str:
    """Text of the content elements, blocks in page order.

    Content is what is likelier content than not; on a page where nothing is, but something holds a sentence,
    what is about as likely as the likeliest sentence, unless that is next to impossible.
    """
    nodes = parse(html)
    marginal = model.marginals(nodes)
    least = 0.5
    shown = [(marginal[i], max((len(p.strip()) for p in node.pieces if isinstance(p, str)), default=0))
             for i, node in enumerate(nodes) if node.tag not in HIDDEN]
    if not any(size and m > 0.5 for m, size in shown):
        least = min(max([m / 2 for m, size in shown if size >= SENTENCE] + [IMPOSSIBLE]), 0.5)
    blocks: list[list[str]] = [[]]
    # An explicit stack: pages may be nested very deep.
    stack: list[tuple[int, Iterator]] = [(0, iter(nodes[0].pieces))]
    while stack:
        i, pieces = stack[-1]
        for piece in pieces:
            if isinstance(piece, str):
                if marginal[i] > least:
                    blocks[-1].append(piece)
                continue
            node = nodes[piece]
            if node.tag == "br":
                blocks[-1].append(" ")
            elif node.tag not in HIDDEN:
                if node.tag in BLOCKS:
                    blocks.append([])
                stack.append((piece, iter(node.pieces)))
                break
        else:
            stack.pop()
            if nodes[i].tag in BLOCKS:
                blocks.append([])
    joined = (" ".join("".join(block).split()) for block in blocks)
    return " ".join(block for block in joined if block)


_MODELS: dict[int, PageModel] = {}


def default_model() -> PageModel:
    """The model of the labelled pages of this package, trained once per worker."""
    if 0 not in _MODELS:
        _MODELS[0] = train(labelled_pages())
    return _MODELS[0]


def extract(pages: DataFrame, html: str = "html", name: str = "text", training: list[str] | None = None) -> DataFrame:
    """Adds the main text of each page.

    `training` are labelled pages (see `train`); by default those of this package. Null and empty html
    give an empty text, and so does a page without content. White space inside a block becomes one
    space, blocks are joined by one space, nothing is cut. Other columns stay; an existing column
    called `name` is replaced. One page is one row's work, and no row is shuffled.
    """

    bound_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = default_model() if training is None else train(training)
        for batch in batches:
            yield pd.Series([main_text(page, model) for page in batch], dtype=object)

    return pages.withColumn(name, run(F.col(html).cast("string")))

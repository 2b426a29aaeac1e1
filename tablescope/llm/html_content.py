"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that is content or not. A node's own potential is a logistic model of its tag,
names, text and links; a potential on each edge says how a child's label follows its parent's. Messages passed up from
the leaves and down from the root give each node's marginal, and the text of nodes that are more likely content than not,
in page order, is the page's main text. So a paragraph with little to tell takes after its article, and an advert inside
an article stands out by its own potential.

Both kinds of potentials are trained on labelled pages: those whose markup says plainly where the article is. To serve
pages that don't say, every training page is also shown with its names and telling tags hidden.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import received, send

#: Pages the model is trained on at most, chosen by a hash of url and id.
SAMPLE = 1_500
#: Ridge towards what is known beforehand, for a loss that is a mean over nodes: pages of one site repeat the same few
#: nodes thousands of times, which are no thousands of observations.
RIDGE = 1 / 400

# Kinds of elements (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe select option button".split())
#: Formulas, drawings and what stands in for embedded things; part of the text they are in.
EMBEDDED = frozenset(
    "noscript object canvas math semantics annotation mi mo mn ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom "
    "menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mspace svg g defs "
    "symbol use path rect circle ellipse line polyline polygon text tspan textpath desc metadata marker lineargradient "
    "radialgradient stop clippath mask pattern filter image foreignobject switch view".split()
)
#: Of these, the ones whose text stands apart from what is before it.
APART = frozenset("noscript object canvas annotation mtr mtd text tspan textpath desc foreignobject".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr".split()
) | EMBEDDED
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"),
}
BARRIERS = frozenset("html body div section article main ul ol dl table aside nav header footer form blockquote".split())
CONTENT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("nav header footer aside form menu dialog address".split())
CONTENT_NAMES = frozenset("article content main post body entry story text".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus feedback foot footer form gdpr head header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted related reply replies respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
NAME = re.compile(r"[a-z]+")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""",
    re.S,
)
SENTENCE = re.compile(r"[.!?]")

PLAIN, MARKED_CONTENT, MARKED_OTHER = 0, 1, 2
FEATURES = 16


class Node:
    """An element; ``mixed`` if one of its names is of content alone and another is not, ``wraps`` if it holds the page."""

    __slots__ = ("tag", "parent", "names", "mixed", "wraps", "chars", "linked", "ends", "all_chars", "all_linked")

    def __init__(self, tag: str, parent: int, names: frozenset = frozenset(), mixed: bool = False):
        self.tag, self.parent, self.names, self.mixed, self.wraps = tag, parent, names, mixed, False
        self.chars = self.linked = self.ends = self.all_chars = self.all_linked = 0


def names_of(attributes: str) -> tuple[frozenset, bool]:
    """The words of an element's names, and whether some names speak for content and others against it."""
    if "=" not in attributes:
        return frozenset(), False
    names = [frozenset(NAME.findall(n)) for _, a, b, c in ATTRIBUTE.findall(attributes) for n in (a or b or c).lower().split()]
    against = [bool(n & OTHER_NAMES) for n in names]
    mixed = any(against) and any(n & CONTENT_NAMES and not bad for n, bad in zip(names, against))
    return frozenset().union(*names), mixed


def find_wrappers(nodes: list[Node], title: int) -> None:
    """Marks the elements that hold the page or article itself, whatever their names say.

    A form, or an element of mixed names, does if it has over half of the unlinked text of its article or page; any other
    named element if it holds the page's first title, too.
    """
    over_title, at = set(), title
    while at > 0:
        at = nodes[at].parent
        over_title.add(at)
    whole: list[int] = []  # the nearest article on the way up, or the page
    for i, node in enumerate(nodes):
        within = whole[node.parent] if i else 0
        whole.append(i if node.tag in CONTENT_TAGS else within)
        if node.tag in INLINE or not (node.tag == "form" or node.names & OTHER_NAMES):
            continue
        most = 2 * (node.all_chars - node.all_linked) > nodes[within].all_chars - nodes[within].all_linked
        titled = i in over_title or node.tag == "form" and title < 0
        node.wraps = most and (node.mixed or titled)


def parse(html: str) -> tuple[list[Node], list[list[tuple[int, str]]]]:
    """The elements of a page, parents first, and its blocks of text in page order: pieces with the node each is of.

    Nodes are the block elements and inline ones whose names speak against content. The time is linear in the page: ends
    without a start, and starts without an end, are told by counts.
    """
    nodes = [Node("root", -1)]
    blocks: list[list[tuple[int, str]]] = []
    path: list[tuple[str, int]] = [("root", 0)]  # open elements; inline ones without a node carry the one they are in
    opened: Counter = Counter()
    endless: set[str] = set()  # tags without a further end
    held: list[tuple[int, str]] = []
    links = at = 0
    title = -1

    def text(piece: str) -> None:
        owner = path[-1][1]
        held.append((owner, piece))
        if links:
            nodes[owner].linked += len(piece.strip())

    def flush() -> None:
        block = [(owner, unescape("".join(p for _, p in pieces))) for owner, pieces in groupby(held, key=itemgetter(0))]
        held.clear()
        for owner, piece in block:
            nodes[owner].chars += len(" ".join(piece.split()))
            nodes[owner].ends += len(SENTENCE.findall(piece))
        if any(piece.strip() for _, piece in block):
            blocks.append(block)

    def close(depth: int) -> None:
        nonlocal links
        tags = [tag for tag, _ in path[depth:]]
        if any(tag not in INLINE for tag in tags):
            flush()
        links -= tags.count("a")
        opened.subtract(tags)
        del path[depth:]

    def start(tag: str, node: int) -> None:
        path.append((tag, node))
        opened[tag] += 1

    while True:
        match = MARKUP.search(html, at)
        if match is None:
            text(html[at:])
            break
        if match.start() > at:
            text(html[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if tag in APART:
            held.append((path[-1][1], " "))
        if match[1]:
            for depth in range(len(path) - 1, 0, -1) if opened[tag] else ():
                if path[depth][0] == tag:
                    close(depth)
                    break
                if tag in INLINE and path[depth][0] not in INLINE:
                    break
            continue
        if tag in RAW and match[3].endswith("/>") and (opened["svg"] or opened["math"]):
            continue  # empty there, as in XML
        if tag in RAW:
            end = None if tag in endless else re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title"):
                at = len(html)
            else:
                endless.add(tag)
            held.append((path[-1][1], " "))
            continue
        if tag in INLINE:
            if tag in VOID:
                held.append((path[-1][1], " "))
            elif not match[3].endswith("/>"):
                owner = path[-1][1]
                names, mixed = names_of(match[3])
                if names & OTHER_NAMES and not mixed and tag not in EMBEDDED:
                    nodes.append(Node(tag, owner, names))
                    owner = len(nodes) - 1
                start(tag, owner)
                links += tag == "a"
            continue
        closes = CLOSES.get(tag, ()) + ("p",)
        for depth in range(len(path) - 1, 0, -1) if any(opened[c] for c in closes) else ():
            name = path[depth][0]
            if name in closes:
                close(depth)
            elif name in BARRIERS:
                break
        flush()
        if tag in VOID or match[3].endswith("/>"):
            continue
        # inline elements left open end with the block that starts here, unless they are nodes
        while path[-1][0] in INLINE and path[-1][1] == path[-2][1]:
            close(len(path) - 1)
        nodes.append(Node(tag, path[-1][1], *names_of(match[3])))
        start(tag, len(nodes) - 1)
        if tag == "h1" and title < 0:
            title = len(nodes) - 1
    close(1)
    flush()
    for node in reversed(nodes):
        node.all_chars += node.chars
        node.all_linked += node.linked
        if node.parent >= 0:
            nodes[node.parent].all_chars += node.all_chars
            nodes[node.parent].all_linked += node.all_linked
    find_wrappers(nodes, title)
    return nodes, blocks


def marking(node: Node) -> int:
    """What a node's tag and names say of it."""
    if node.tag in OTHER_TAGS and not (node.tag == "form" and node.wraps):
        return MARKED_OTHER
    if node.names & OTHER_NAMES and node.tag != "body" and not node.wraps and not (node.mixed and node.tag in CONTENT_TAGS):
        return MARKED_OTHER  # an article, too, if it is called a comment
    if node.tag in CONTENT_TAGS or node.names & CONTENT_NAMES:
        return MARKED_CONTENT
    return PLAIN


def features(nodes: list[Node], hidden: bool = False) -> np.ndarray:
    """A row per node; ``hidden`` leaves out what its tag and names say."""
    rows = np.zeros((len(nodes), FEATURES))
    inside: list[int] = []  # the nearest mark on the way up
    for row, node in zip(rows, nodes):
        mark = PLAIN if hidden else marking(node)
        above = inside[node.parent] if node.parent >= 0 else PLAIN
        inside.append(mark or above)
        row[0] = 1.0
        row[1], row[2] = mark == MARKED_CONTENT, mark == MARKED_OTHER
        row[3] = node.tag == "p"
        row[4] = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        row[5] = node.tag in ("li", "ul", "ol", "dl", "dt", "dd")
        row[6] = node.tag in ("td", "th", "tr", "table")
        row[7] = node.tag in ("div", "section", "td")
        row[8] = math.log1p(node.chars) / 5
        row[9] = math.log1p(node.all_chars) / 5
        row[10] = node.linked / (node.chars + 1)
        row[11] = node.all_linked / (node.all_chars + 1)
        row[12] = min(1.0, 50 * node.ends / (node.chars + 1))
        row[13] = node.chars > 0
        row[14], row[15] = above == MARKED_CONTENT, above == MARKED_OTHER
    return rows


def marked_labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page whose markup tells its one article from the rest; null for other pages."""
    if sum(n.tag == "article" for n in nodes) != 1 or not any(n.tag in OTHER_TAGS for n in nodes):
        return None
    labels: list[int] = []
    for node in nodes:
        mark, above = marking(node), labels[node.parent] if node.parent >= 0 else 0
        labels.append(0 if mark == MARKED_OTHER else 1 if node.tag == "article" else above)
    return labels


class TreeModel:
    """``weights`` of the nodes' features; ``edges[kind][parent][child]``, potentials by what the child's markup says."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of every node, by messages up and down the tree."""
        odds = np.clip(features(nodes) @ self.weights, -20, 20).tolist()
        edges = self.edges.tolist()
        own = [(1 / (1 + math.exp(o)), 1 / (1 + math.exp(-o))) for o in odds]
        kinds = [marking(n) for n in nodes]
        # beliefs from below, and the message each node sends up; parents come before children in ``nodes``
        below = [list(p) for p in own]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            e, (b0, b1) = edges[kinds[i]], below[i]
            m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
            total = m0 + m1
            up[i] = m0, m1 = m0 / total, m1 / total
            held = below[nodes[i].parent]
            held[0], held[1] = held[0] * m0, held[1] * m1
            if (total := held[0] + held[1]) < 1e-100:
                held[0], held[1] = held[0] / total, held[1] / total
        full = [tuple(b) for b in below]
        for i in range(1, len(nodes)):
            p0, p1 = full[nodes[i].parent]
            m0, m1 = up[i]
            p0, p1 = p0 / max(m0, 1e-12), p1 / max(m1, 1e-12)
            e, (b0, b1) = edges[kinds[i]], below[i]
            d0, d1 = p0 * e[0][0] + p1 * e[1][0], p0 * e[0][1] + p1 * e[1][1]
            x0, x1 = b0 * d0, b1 * d1
            total = x0 + x1 or 1.0
            full[i] = x0 / total, x1 / total
        return [b / (a + b or 1.0) for a, b in full]

    def main_text(self, html: str) -> str:
        nodes, blocks = parse(html)
        marginals = self.marginals(nodes)
        kept = ("".join(piece for owner, piece in block if marginals[owner] > 0.5) for block in blocks)
        return "\n".join(filter(None, (" ".join(block.split()) for block in kept)))


def labelled_pages(pages: DataFrame, html: str = "html") -> int:
    """How many pages ``marked_labels`` can label, by their start tags: this sizes the sample and needs no parse."""
    text = F.lower(F.col(html))
    one = F.regexp_count(text, F.lit(r"<article[\s>]")) == 1
    return pages.filter(one & text.rlike(rf"<({'|'.join(sorted(OTHER_TAGS))})[\s>/]")).count()


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE, ridge: float = RIDGE) -> TreeModel:
    """The model from at most about ``sample`` labelled pages; from prior counts alone if none are labelled.

    The mean loss over nodes plus ``ridge`` times the squared distance from the prior; few nodes count once at most.
    """
    total = labelled_pages(pages, html)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in ("url", "page_id") if c in pages.columns]), F.lit(1 << 20))
    chosen = pages.filter(part < math.ceil((1 << 20) * min(1.0, sample / max(1, total)))).select(html)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks, edges = [], [], []
            for page in batch.column(0):
                nodes, _ = parse(page.as_py() or "")
                labels = marked_labels(nodes)
                if labels is None:
                    continue
                for hidden in (False, True):
                    rows.extend(features(nodes, hidden).tolist())
                    marks.extend(labels)
                    for node, label in zip(nodes, labels):
                        above = labels[node.parent] if node.parent >= 0 else -1
                        edges.append(-1 if above < 0 else 4 * (PLAIN if hidden else marking(node)) + 2 * above + label)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), pa.array(marks, pa.int32()), pa.array(edges, pa.int32())],
                names=["features", "label", "edge"],
            )

    got = chosen.mapInArrow(labelled, "features array<double>, label int, edge int").groupBy("features", "label", "edge").count()
    table = got.toArrow()  # nodes of the sample
    times = table.column("count").to_numpy().astype(float)
    times = times * min(1.0, 1 / (ridge * max(1.0, times.sum())))
    labels = table.column("label").to_numpy().astype(float)
    x = np.array(table.column("features").to_pylist(), float).reshape(-1, FEATURES)
    edge = table.column("edge").to_numpy()
    # what the markup says, as pseudo-counts: a marked child goes by its mark, a plain one by its parent
    counts = np.array([[[20.0, 1.0], [1.0, 20.0]], [[1.0, 20.0], [1.0, 20.0]], [[20.0, 1.0], [20.0, 1.0]]])
    np.add.at(counts.reshape(-1), edge[edge >= 0], np.minimum(times[edge >= 0], 1e9))
    given = counts / counts.sum(2, keepdims=True)
    edges = given / given.mean(1, keepdims=True)  # a child's own share is in its node's potential
    # a mark, a paragraph and a heading, lists, own text, links, sentences, marks above
    prior = np.array([-1.0, 5.0, -6.0, 1.0, 1.0, -0.5, 0.0, 0.0, 0.5, 0.0, -3.0, -2.0, 1.0, 0.0, 1.0, -5.0])
    weights = prior.copy()
    if 0 < (labels * times).sum() < times.sum():
        for _ in range(30):  # Newton steps for a logistic model that stays near the prior
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (times * (p - labels)) + (weights - prior)
            step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.eye(FEATURES), gradient)
            weights = weights - step
            if np.abs(step).max() < 1e-6:
                break
    return TreeModel(weights, edges)


def extract(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (``page_id, url, html`` and any others, not read).

    Blocks are joined in page order by one newline, white space inside a block is one space. Null and empty pages, and
    pages without content, have an empty text. Broken markup is read as far as it goes. Equal rows give equal rows; an
    empty table gives an empty result.
    """
    model = send(pages.sparkSession, train(pages, html, sample))  # a few dozen numbers

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = received(model)
        for batch in batches:
            texts = [tree.main_text(p.as_py() or "") for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.select("page_id", "url", F.col(html)).mapInArrow(
        extracted, f"page_id {id_type}, url {url_type}, text string"
    )

"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks: runs of text between block-level tags. A linear classifier scores each block as content from
its ancestors (elements, roles, class and id words), link share, length and punctuation. The cost of calling a block boilerplate
(or content) is the capacity of its edge from the source (or to the sink); neighbours in page order, and blocks under the
same parent, get smoothness edges that weaken with their distance in the tree. The minimum cut separates content from
boilerplate, so a short block between paragraphs follows them, and a menu next to them does not.

Pages are independent: a map without a shuffle, inside Arrow batches. Reading a page is linear in its length, however deep or
broken its markup: no tag is searched twice, open elements are found by name, and what their ancestors say is summed from the top down.
Edges are in proportion to blocks; the flow starts from the difference of both terminal capacities, so it only has to move what
neighbours of unlike sign share.

Defined cases: null or empty html has empty text. Broken markup is read as browsers do in the main: a block-level tag ends an open
paragraph, an end tag closes all inside it, scripts, styles, titles and text areas without an end reach to the end of the page, while of
other skipped elements without an end only the start tag is skipped. `<` without a `>` behind it is text. Equal blocks stay as often as
they occur. Repeated rows get the same answer. Extra columns pass through `extract`; one named as a result column (in any letter case)
gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Starts of tags; quoted values may hold ">". A tag whose quotes don't pair up ends at its first ">".
_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_SPECIAL = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAMES = frozenset("class id role itemprop style hidden aria-hidden".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# Elements of the HTML vocabulary by their role here.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas math select audio video".split())
#: Of these, the ones that reach to the end of the page if they have no end.
ENDLESS = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that begins ends an open one of these, up to the container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup signin login register share sharing social sidebar side rail widget widgets related recommended recommendations "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments commentlist respond reply replies "
    "disqus discussion feedback copyright legal disclaimer search skip form outbrain taboola teaser trending popular".split())
#: Inside an article these may also name a part of it: they count unless the part is long and has few links.
AMBIGUOUS = frozenset("discussion legal feedback notice notices search form related popular trending side promotion registration".split())
#: Not boilerplate inside an article: its own head.
ARTICLE_PARTS = frozenset("header masthead banner".split())
CONTENT_WORDS = frozenset("article content entry post story main body text paragraph".split())
# Weights of the classifier (log odds of content).
W_BASE, W_BOILER, W_BOILER_CLASS, W_MAIN, W_CONTENT_CLASS, W_PARAGRAPH = -0.4, -12.0, -10.0, 3.5, 1.2, 0.8
W_LINKS, W_STOP, W_LONG, W_HEADING, W_RIGHTS, W_PAGE_HEADER = -4.0, 0.7, 0.5, 0.6, -3.0, -10.0
SMOOTH_NEXT, SMOOTH_PARENT, SCALE = 1.2, 0.8, 1000
#: Where blocks that score as content hold less than LEAST of a page's unlinked text, a wrapper with more than MOST of it is not boilerplate.
MOST, LEAST = 0.6, 0.05
#: A part is long above so many code points, and has few links below such a share of linked text.
LONG, FEW_LINKS = 300, 0.2


class Node:
    """An open element, its parent, what it says of the blocks inside, and the sums of what its ancestors say.

    holder: nearest block-level element, itself included. depth: in all elements. level: in block-level ones.
    bad, best, hidden: of it and its ancestors; the first two are set by `_settle`.
    """

    __slots__ = ("name", "parent", "depth", "level", "holder", "score", "by_class", "doubtful", "main", "link", "inside", "own_hidden", "hidden", "held",
                 "linked", "bad", "best")

    def __init__(self, name: str, parent: "Node | None", score: float = 0.0, by_class: float = 0.0, hidden: float = 0.0, doubtful: bool = False):
        self.name, self.parent, self.score, self.by_class, self.doubtful, self.main = name, parent, score, by_class, doubtful, False
        self.held = self.linked = 0
        self.bad = self.best = 0.0
        block = parent is None or name in BLOCK
        self.holder = self if block else parent.holder
        self.depth = parent.depth + 1 if parent else 0
        self.level = parent.level + block if parent else 0
        self.own_hidden = hidden
        self.hidden = parent.hidden + hidden if parent else hidden
        self.link = name == "a" or bool(parent and parent.link)
        self.inside = name in ("article", "main") or bool(parent and parent.inside)


class Block:
    __slots__ = ("text", "linked", "node")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node = text, linked, node


def _scores(name: str, attrs: str, inside: bool) -> tuple[float, float, float, bool]:
    """Score of an element for what it holds: by its kind, by its class and id words, for being hidden, and whether its words are ambiguous.

    inside: it is in an article.
    """
    own = W_BOILER if name in BOILER_TAGS else W_MAIN if name in ("article", "main") else W_PAGE_HEADER if name == "header" and not inside else 0.0
    by_class = hidden = 0.0
    doubtful = False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key = m[1].lower()
            if key not in _NAMES:
                continue
            value = (m[2] or "").strip("\"'")
            if key == "role":
                role = value.lower()
                own += W_BOILER if role in BOILER_ROLES else W_MAIN if role in ("main", "article") else 0.0
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden += W_BOILER
            elif key == "itemprop" and value.lower() == "articlebody":
                own += W_MAIN
            elif key in ("class", "id") and name not in ("html", "body"):
                words = {w.lower() for w in _WORDS.findall(value)}
                bad = words & (BOILER_WORDS - ARTICLE_PARTS if inside else BOILER_WORDS)
                if bad:
                    doubtful = inside and bad <= AMBIGUOUS and (doubtful or by_class >= 0)
                    by_class = W_BOILER_CLASS
                elif words & CONTENT_WORDS and by_class >= 0:
                    by_class = W_CONTENT_CLASS
    return own, by_class, hidden, doubtful


class _Tags:
    """The tags of a page in order, each found by one search: (start, end, is an end tag, name, attributes)."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[int, int] | None = None
        self.specials: list[int] = []
        self.no_end: set[str] = set()

    def _build_ends(self) -> None:
        """For each of > " ' as the next special character of a tag: where the tag ends, -1 if never. Right to left, once a page."""
        page, self.ends = self.page, {}
        self.specials = [m.start() for m in _SPECIAL.finditer(page)]
        ahead = {'"': -1, "'": -1}  # number in `specials` of the next quote of each kind
        ends = [-1] * (len(self.specials) + 1)
        for i in range(len(self.specials) - 1, -1, -1):
            c = page[self.specials[i]]
            if c == ">":
                ends[i] = self.specials[i]
            else:
                ends[i] = ends[ahead[c] + 1] if ahead[c] >= 0 else -1
                ahead[c] = i
            self.ends[self.specials[i]] = ends[i]

    def _close(self, at: int) -> int:
        """Where a tag ends whose attributes begin at `at`; there is a ">" behind it."""
        if self.ends is None:
            m = _REST.match(self.page, at)
            if m:
                return m.end() - 1
            self._build_ends()
        i = bisect_left(self.specials, at)
        end = self.ends[self.specials[i]]
        return end if end >= 0 else self.page.index(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        m = _START.search(self.page, at) if at <= self.last or self.page.find("<!--", at) >= 0 else None
        while m and m.end() > self.last:  # nothing closes any more: only a comment still counts
            if m[0] == "<!--":
                break
            m = re.compile("<!--").search(self.page, m.end())
        if not m:
            return None
        start, after = m.start(), m.end()
        if m[0] == "<!--":
            end = self.page.find("-->", after)
            return start, end + 3 if end >= 0 else len(self.page), False, "", ""
        if not m[2]:
            return start, self.page.index(">", after) + 1, False, "", ""
        end = self._close(after)
        return start, end + 1, bool(m[1]), m[2].lower(), self.page[after:end]

    def after_end(self, name: str, at: int) -> int | None:
        """Behind the end tag of a skipped element, None if it has none; the page is searched to its end once a name."""
        if name not in self.no_end:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
            if m and m.end() <= self.last:
                return self.page.index(">", m.end()) + 1
            self.no_end.add(name)
        return None


def blocks_of(page: str) -> list[Block]:
    root = Node("", None)
    top, found, pieces, linked = root, [], [], 0
    nodes, opened = [root], {}  # all elements, parents first; the open ones by name, outermost first
    article_seen = False
    at, n = 0, len(page)
    tags = _Tags(page)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append(Block(text, linked, top.holder))
            pieces, linked = [], 0

    def close(node: Node) -> None:
        """End this open element and all inside it."""
        nonlocal top
        while top is not node.parent:
            opened[top.name].pop()
            top = top.parent

    while at < n:
        tag = tags.next(at)
        stop = tag[0] if tag else n
        if stop > at:
            piece = page[at:stop]
            pieces.append(piece)
            if top.link:
                linked += len(piece.strip())
        if not tag:
            break
        _, at, is_end, name, attrs = tag
        if not name:
            continue
        if is_end:
            if name in BLOCK:
                flush()
            if opened.get(name):
                node = opened[name][-1]
                if name in BLOCK or top.level == node.level:
                    close(node)
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                end = tags.after_end(name, at)
                at = end if end is not None else n if name in ENDLESS else at
            pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
            node = top.holder  # an open paragraph or heading ends where a block begins
            if node.name == "p" or node.name in HEADINGS and name in HEADINGS:
                close(node)
        if name in CLOSES:
            ends, within = CLOSES[name]
            floor = max((opened[w][-1].depth for w in within if opened.get(w)), default=0)
            outer = [opened[e][i] for e in ends if opened.get(e) for i in [bisect_right(opened[e], floor, key=lambda x: x.depth)] if i < len(opened[e])]
            if outer:
                close(min(outer, key=lambda x: x.depth))
        if name in VOID:
            pieces.append(" ")
            continue
        top = Node(name, top, *_scores(name, attrs, top.inside))
        nodes.append(top)
        opened.setdefault(name, []).append(top)
        if name in ("article", "main") and top.by_class >= 0 and (name == "main" or not article_seen):
            article_seen = True
            node = top.parent
            while node is not root and not node.main:  # a wrapper of the article isn't a menu, whatever its class says
                node.main = True
                node = node.parent
    flush()
    for b in found:
        b.node.held += len(b.text)
        b.node.linked += min(b.linked, len(b.text))
    for node in reversed(nodes[1:]):
        node.parent.held += node.held
        node.parent.linked += node.linked
        if node.doubtful and node.held > LONG and node.linked < FEW_LINKS * node.held:
            node.by_class = 0.0
    _settle(nodes)
    if not article_seen:
        _lift_wrappers(found, nodes)
    return found


def _settle(nodes: list[Node]) -> None:
    """Sums over ancestors: every sign of boilerplate counts (a wrapper's only if it is hidden), the strongest sign of content once."""
    for node in nodes[1:]:
        up = node.parent
        bad = 0.0 if node.main else min(0.0, node.score) + min(0.0, node.by_class)
        node.bad = up.bad + bad + node.own_hidden
        node.best = max(up.best, node.score, node.by_class)


def _lift_wrappers(blocks: list[Block], nodes: list[Node]) -> None:
    """A wrapper of most of the unlinked text isn't a menu if next to nothing else is content; what is hidden stays as it is."""
    total = clear = 0
    for node in nodes:
        node.held = 0
    for b in blocks:
        size = 0 if b.node.hidden else max(0, len(b.text) - b.linked)
        total += size
        clear += size if score(b) > 0 else 0
        b.node.held += size
    if clear >= LEAST * total:
        return
    for node in reversed(nodes[1:]):
        node.parent.held += node.held
        node.main = node.main or node.held > MOST * total
    _settle(nodes)


def score(b: Block) -> float:
    """Log odds that the block is content."""
    s = W_BASE + b.node.bad + b.node.best
    size = len(b.text)
    s += W_PARAGRAPH * (b.node.name in ("p", "blockquote", "pre")) + W_HEADING * (b.node.name in HEADINGS)
    s += W_LINKS * min(1.0, b.linked / max(1, size)) + W_STOP * (b.text[-1] in ".!?:;\"'”»…。！？") + W_LONG * min(4.0, math.log1p(size / 40))
    if b.text.startswith("©") or size < 200 and re.search(r"all rights reserved|copyright", b.text, re.I):
        s += W_RIGHTS
    return s


def _apart(a: Node, b: Node) -> int:
    """Steps between two block-level elements over their nearest common one; what is inline between them doesn't count."""
    steps = 0
    while a is not b:
        if a.level >= b.level:
            a = a.parent.holder
        else:
            b = b.parent.holder
        steps += 1
    return steps


def min_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut. gains: capacity from the source less that to the sink."""
    n = len(gains)
    link: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[int] = []
    for a, b, c in edges:
        link[a].append(len(to))
        link[b].append(len(to) + 1)
        to += (b, a)
        cap += (c, c)
    excess = list(gains)
    while True:  # blocking flows along shortest paths from nodes with supply to nodes with demand
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            u = queue.popleft()
            if excess[u] < 0:
                reached = True
                continue
            for e in link[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while excess[s] > 0:
                path, u = [], s
                while True:
                    if excess[u] < 0:
                        break
                    while turn[u] < len(link[u]):
                        e = link[u][turn[u]]
                        if cap[e] and level[to[e]] == level[u] + 1:
                            break
                        turn[u] += 1
                    if turn[u] < len(link[u]):
                        path.append(e)
                        u = to[e]
                    elif path:
                        u = to[path.pop() ^ 1]
                        turn[u] += 1
                    else:
                        break
                if excess[u] >= 0:
                    break
                push = min([excess[s], -excess[u], *(cap[e] for e in path)])
                excess[s] -= push
                excess[u] += push
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push


def label(blocks: list[Block]) -> list[bool]:
    """Content or not, for each block."""
    gains = [round(SCALE * score(b)) for b in blocks]  # softplus(s) - softplus(-s) = s
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(SCALE * SMOOTH_NEXT / (1 + _apart(blocks[i - 1].node, b.node)))))
        parent = b.node.parent or b.node
        before = last.get(id(parent))
        if before is not None:
            edges.append((before, i, round(SCALE * SMOOTH_PARENT)))
        last[id(parent)] = i
    return min_cut(gains, edges)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks)) if keep) if blocks else ""


def extract(pages: DataFrame, html_column: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The columns of `pages` but the html, plus the main text and its number of code points."""
    kept = [c for c in pages.columns if c != html_column and c.lower() not in (text.lower(), n_chars.lower())]
    frame = pages.select(html_column, *kept)
    schema = frame.select(*kept, F.lit("").alias(text), F.lit(0).cast("bigint").alias(n_chars)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            arrays = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(arrays, names=[*kept, text, n_chars])

    return frame.mapInArrow(run, schema)

"""HTML extraction by minimum-cut labelling of text blocks.

A page's text falls into blocks at block-level tags; text in an inline element of its own part (such as an advert's span)
is a block beside the one it stands in. A linear classifier over a block's place (its ancestors' tags, classes, ids and
roles), link share and length gives log-odds of being content; they become terminal capacities. Its weights are set by hand,
as there are no labelled pages to fit them on. What an element is called counts against what it holds: one with half of the page's
prose or more that is, or has inside it, an article, a main part or the page's heading is no boilerplate, whatever its classes say,
nor is what stands around the page's longest article, if that has a quarter of the prose (forms around whole pages, layouts named after their sidebar). Classes that tell a state or a taxonomy ("comments-open",
"category-legal") and attributes of other names ("data-id") say nothing of a part.
Smoothness edges join blocks that follow each other, more strongly under one parent, and each block to the one before it
under the same parent (DOM proximity). A maximum flow separates content from boilerplate.

Pages are independent, so this is one pass of Arrow batches without a shuffle.

Edge cases: a null or empty page, or one without content, has the empty text. Markup that isn't closed runs to the end of
its parent, an unclosed comment or script to the end of the page. Repeated pages keep a row each. Nothing is cut off.
Open elements are found by name and depth, so that stray end tags and deep nesting take no walk over all ancestors.
Columns of the pages called as the result's are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import table

# HTML element names by their part in a page, and words of class, id and role that tell a part.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "select", "title", "audio", "video")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner promo promotion sponsor sponsored outbrain taboola menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer header masthead toolbar "
    "comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search pagination pager copyright legal disclaimer skip tags complementary contentinfo toc login form".split()
)
GOOD_WORDS = frozenset("article content main story entry post articlebody body text".split())
#: First parts of class names that tell a state or a taxonomy, and last ones that tell a state.
NO_PART = frozenset("has with no is not category cat tag term type status format author".split())
STATES = frozenset("open opened closed enabled disabled".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>", re.I | re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HINTS = frozenset(("class", "id", "role", "itemprop"))
_SENTENCE_END = re.compile(r"[.!?…。]['\"»”)]*$")
_OWNER = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved", re.I)


class _Node:
    """An element. ``called`` and ``fine``: whether its name or its classes call it boilerplate, or content; ``bad`` and ``good`` are decided when the page is read."""

    __slots__ = ("aside", "bad", "block", "called", "depth", "fine", "good", "holds", "name", "parent", "prose")

    def __init__(self, name: str, attributes: str, parent: _Node | None):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block: _Node | None = self if name in BLOCK else parent.block if parent else None
        self.aside: _Node | None = parent.aside if parent and name not in BLOCK else None  # the outermost inline element that is called boilerplate
        self.bad = self.good = False
        self.prose, self.holds = 0.0, name in GOOD_TAGS or name == "h1"
        words, good_token = _words(attributes) if attributes and name not in ("html", "body") else (set(), False)
        self.called = name in BAD_TAGS or bool(words & BAD_WORDS)
        self.fine = name in GOOD_TAGS or good_token
        if self.called:
            self.holds = False
            if name not in BLOCK and self.aside is None:
                self.aside = self


def _words(attributes: str) -> tuple[set[str], bool]:
    """The parts of an element's class names, ids and roles that may tell its part in the page, and whether one of the names speaks for content alone."""
    words: set[str] = set()
    good = False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in _HINTS:
            continue
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            parts = re.split(r"[-_]+", token)
            if parts[0] in NO_PART and len(parts) > 1 or parts[-1] in STATES:
                continue
            words.update(parts)
            good = good or not GOOD_WORDS.isdisjoint(parts) and BAD_WORDS.isdisjoint(parts)
    return words, good


class Block:
    """A block's text and what its classifier looks at."""

    __slots__ = ("heading", "links", "node", "text")

    def __init__(self, text: str, links: int, node: _Node, heading: bool):
        self.text, self.links, self.node, self.heading = text, links, node, heading

    def prose(self) -> float:
        """Characters, those of what is no sentence or is mostly links at a tenth."""
        n = len(self.text)
        return n if self.links <= 0.4 * n and (n >= 80 or _SENTENCE_END.search(self.text)) else 0.1 * n

    def log_odds(self) -> float:
        n = len(self.text)
        share = min(1.0, self.links / n)
        z = -0.7 + 2.7 * min(1.0, n / 160) + (0.8 if _SENTENCE_END.search(self.text) else 0.0) + (0.5 if self.heading else 0.0)
        z -= share if share <= 0.4 else 2.0 * share if self.node.good else 4.5 * share  # an article's own lists may be links
        if self.node.good:
            z += 3.5
        elif _OWNER.search(self.text):
            z -= 3.0
        return z - 8.0 * self.node.bad


class _Open:
    """The stack of open elements, and for each name those of it."""

    def __init__(self) -> None:
        self.node = self.root = _Node("", "", None)
        self.nodes = [self.root]  # parents before their children
        self.by_name: dict[str, list[_Node]] = {}

    def push(self, name: str, attributes: str) -> None:
        self.node = _Node(name, attributes, self.node)
        self.nodes.append(self.node)
        self.by_name.setdefault(name, []).append(self.node)

    def find(self, name: str, stops: tuple[str, ...] = ()) -> _Node | None:
        """The innermost open element of a name, unless a stop is open inside it."""
        depth = lambda x: self.by_name[x][-1].depth if self.by_name.get(x) else 0
        if not depth(name) or any(depth(s) > depth(name) for s in stops):
            return None
        return self.by_name[name][-1]

    def close(self, node: _Node) -> None:
        while self.node.depth >= node.depth:
            self.by_name[self.node.name].pop()
            self.node = self.node.parent or self.root

    def decide(self, found: list[Block]) -> None:
        """Sets ``bad`` and ``good`` of all elements, by what they are called and how much of the page's prose they hold."""
        for b in found:
            b.node.prose += b.prose()
        for x in reversed(self.nodes[1:]):
            x.parent.prose += x.prose
            x.parent.holds |= x.holds
        most = 0.5 * self.root.prose
        parts = [x for x in self.nodes if x.name in GOOD_TAGS and not x.called]
        longest = max((x.prose for x in parts), default=0.0)
        around: set[int] = set()
        if longest >= 0.5 * most > 0:
            x = [x for x in parts if x.prose >= 0.8 * longest][-1]  # the innermost
            while x is not None:
                around.add(id(x))
                x = x.parent
        for x in self.nodes[1:]:
            over = x.parent
            bad = x.called and id(x) not in around and not (x.prose >= most > 0 and (x.fine or x.holds))
            x.bad = over.bad or bad or x.name == "header" and not over.good
            x.good = over.good or x.fine and (not bad or x.name in GOOD_TAGS)


_P_STOPS = ("div", "article", "section", "main", "body", "td", "li", "aside", "nav", "footer", "header", "form", "blockquote", "button")


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    opened, out = _Open(), []
    held: list[str] = []
    beside: list[tuple[_Node, list[str]]] = []  # texts of inline elements that are blocks of their own
    links = in_link = 0

    def block(parts: list[str], links: int, place: _Node, heading: bool = False) -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, links, place, heading))

    def close() -> None:
        nonlocal links
        place = opened.node.block or opened.node
        block(held, links, place, len(place.name) == 2 and place.name[0] == "h" and place.name[1] in "123456")
        for node, parts in beside:
            block(parts, 0, node)
        held.clear(), beside.clear()
        links = 0

    def text(x: str) -> None:
        nonlocal links
        if not x:
            return
        if (aside := opened.node.aside) is not None:
            if not beside or beside[-1][0] is not aside:
                beside.append((aside, []))
            beside[-1][1].append(x)
            return
        held.append(x)
        if in_link:
            links += len(" ".join(entities.unescape(x).split()))

    last, whole = 0, page.rfind(">") + 1  # no tag ends after it
    for m in _TOKEN.finditer(page, 0, whole):
        text(page[last : m.start()])
        last = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1] and m[1].lower() in ("title", "iframe", "video", "audio"):
                close()
            if last == whole and (m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I) or m[0].startswith("<!--") and not m[0].endswith("-->")):
                last = len(page)  # unclosed: it runs to the end
            continue
        name, ends = name.lower(), m[2] or m[5]
        if name in BLOCK:
            close()
        elif name == "br":
            text(" ")
        if name in VOID:
            continue
        if ends:
            found = opened.find(name)
            if found is not None:
                opened.close(found)
            if name == "a":
                in_link = 0
            continue
        if name in BLOCK and (p := opened.find("p", _P_STOPS)) is not None:
            opened.close(p)
        if name in CLOSES:
            for same in (name, CLOSES[name][0]):
                if (x := opened.find(same, CLOSES[name][1])) is not None:
                    opened.close(x)
        opened.push(name, m[4] or m[7] or "")
        if name == "a":
            in_link = 1
        elif name in BLOCK and name not in ("li",):
            in_link = 0
    text(page[last:].partition("<!--")[0])
    close()
    opened.decide(out)
    return out


def cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: True for nodes on the source's side. ``odds``: capacity from the source if positive, else to the sink.

    Paths are augmented from one node with excess after another; nodes from which no sink is left to reach are done with,
    and are the source's side in the end.
    """
    n = len(odds)
    left = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    done = [False] * n
    tiny = 1e-9
    for s in range(n):
        while left[s] > tiny and not done[s]:
            came = {s: s}
            queue, goal = deque([s]), -1
            while queue and goal < 0:
                u = queue.popleft()
                for v, room in near[u].items():
                    if room > tiny and v not in came and not done[v]:
                        came[v] = u
                        if left[v] < -tiny:
                            goal = v
                            break
                        queue.append(v)
            if goal < 0:
                for v in came:
                    done[v] = True
                break
            flow, v = min(left[s], -left[goal]), goal
            while v != s:
                flow, v = min(flow, near[came[v]][v]), came[v]
            v = goal
            while v != s:
                u = came[v]
                near[u][v] -= flow
                near[v][u] += flow
                v = u
            left[s] -= flow
            left[goal] += flow
    return done


def main_text(page: str | None, smoothness: float = 1.0) -> str:
    found = blocks(page or "")
    edges: list[tuple[int, int, float]] = []
    before: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.node.parent
        if i:
            a = found[i - 1].node
            same = a is b.node or a.parent is parent
            edges.append((i - 1, i, smoothness * (0.8 if same else 0.4 if a.parent and parent and a.parent.parent is parent.parent else 0.15)))
        if (j := before.get(id(parent))) is not None:
            edges.append((j, i, 0.3 * smoothness))
        before[id(parent)] = i
    keep = cut([b.log_odds() for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text``."""
    keep = [f for f in pages.schema.fields if f.name not in (html, "text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.slice(k, 500)
                texts = pa.array([main_text(x) for x in part.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), texts], [*(f.name for f in keep), "text"])

    return pages.select(*(f.name for f in keep), html).mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))

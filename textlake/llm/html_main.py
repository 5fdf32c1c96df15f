"""Main text of HTML pages by minimum-cut labelling.

1. A page is scanned into blocks: runs of text between block-level tags, with the open elements around them. Scripts,
   styles, comments and other raw-text elements are skipped whole. Embedded elements (buttons, pictures, players,
   templates) are nodes whose text is not read: one that is not closed ends with its parent, at an article, main,
   section or heading (where it cannot hold one), or is ignored where no end tag of its kind follows. Unclosed ``p`` and ``li`` elements end
   where HTML says they do. Character references are decoded, white space inside a block becomes one blank.
2. A classifier gives every block a cost for being labelled content and one for boilerplate, from its enclosing
   elements (semantic tags, class and id words, roles), link density, length and punctuation. The costs are the
   capacities to the two terminals.
3. Neighbouring blocks in page order, and neighbouring blocks under the same parent element, are tied by smoothness
   edges. Ties fall with DOM distance (steps from block to block over the tree).
4. The minimum cut (max-flow by shortest augmenting paths) separates content from boilerplate; content blocks are
   joined in page order by two line feeds.

A page is one row, so the graph is bounded by the page and lives in one Arrow task call. Ties in the cut go to
boilerplate (a block is content only if the content terminal still reaches it). Nulls: a null or empty page has an
empty text. Repeated rows are extracted each. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textlake.llm.common import prepare

# Element groups of HTML.
RAW = {"script", "style", "textarea", "iframe", "title", "noframes", "noembed"}
EMBEDDED = {"noscript", "template", "svg", "object", "select", "button", "canvas", "audio", "video", "map",
            "annotation", "annotation-xml"}
#: a start tag of these ends an open embedded element, unless it is one of the second group, which may hold them
ENDS_EMBEDDED = {"article", "main", "section", "h1", "h2", "h3", "h4", "h5", "h6"}
HOLDS_FLOW = {"noscript", "template", "object", "foreignobject"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr", "img", "br",
          "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup",
          "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "mstyle",
          "mpadded", "mphantom", "menclose", "merror"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol",
            "p", "pre", "section", "table", "ul"}
ENDS_AT = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
           "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
           "option": ("option", {"select"})}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
CONTENT_TAGS = {"article", "main"}
BOILER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disqus|footer|gdpr|header|"
    r"login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|pager|popup|promo|promoted|"
    r"related|repl(?:y|ies)|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|tags|teaser|toc|"
    r"toolbar|widget|alert|respond|reactions?|recommended)(?:$|[\s_-])", re.I)
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}

#: a comment, declaration, or the start of a tag with its name; names are cut at 64 characters
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]{0,63})""", re.S)
REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
MARK = re.compile(r"""[>"']""")
#: an attribute starts where a run of name characters starts, so a run is read once
ATTR = re.compile(r"""(?<![^\s"'>/=])([^\s"'>/=]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++)""")
#: weight of a smoothness edge between blocks at DOM distance 1, its fall-off, and the cost of a certain ancestor
SMOOTH, FALL, CERTAIN = 0.6, 0.5, 8.0
#: what a boilerplate word weighs inside an article where it is only part of a class token, or a whole id
DOUBT = 11.0


def boiler_weight(classes: str, ident: str, story: bool) -> float:
    """Weight of the boilerplate words in an element's class and id.

    Inside an article only a whole class token is certain; a part of one, or an id that is the word, can be outvoted
    by length and punctuation, and a word inside a longer id (a heading's slug) says nothing.
    """
    if not (BOILER_WORDS.search(classes) or BOILER_WORDS.search(ident)):
        return 0.0
    if not story or any(BOILER_WORDS.fullmatch(c) for c in classes.split()):
        return 2 * CERTAIN
    return DOUBT if BOILER_WORDS.search(classes) or BOILER_WORDS.fullmatch(ident) else 0.0


class Node:
    """An open element: tag, parent, depth and its summed verdict (positive: content)."""

    __slots__ = ("tag", "up", "depth", "lean", "story", "link", "embedded", "block")

    def __init__(self, tag: str, up: Node | None, attrs: str = ""):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        #: the nearest element from here up that is not inline
        self.block = up.block if up and tag in INLINE else self
        self.lean, self.story = (up.lean, up.story) if up else (0.0, False)
        self.link = bool(up and up.link) or tag == "a"
        self.embedded = bool(up and up.embedded) or tag in EMBEDDED
        got, names, hidden, words = {}, "", False, 0.0
        if attrs:
            got = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTR.findall(attrs)} if "=" in attrs else {}
            names = f"{got.get('class', '')} {got.get('id', '')}".strip()
            if names and tag not in ("body", "html", "article", "main"):
                words = boiler_weight(got.get("class", ""), got.get("id", "").strip(), self.story)
            hidden = ("hidden" in attrs.lower().split() or got.get("aria-hidden") == "true"
                      or "display:none" in got.get("style", "").replace(" ", "").lower())
        boiler = (tag in BOILER_TAGS or got.get("role") in BOILER_ROLES or hidden
                  or tag == "header" and not self.story)
        if boiler or words:
            self.lean -= 2 * CERTAIN if boiler else words
        elif tag in CONTENT_TAGS or got.get("role") in ("main", "article"):
            # an article inside boilerplate (a teaser in a sidebar, a comment) does not win over it
            self.lean, self.story = self.lean + (CERTAIN if self.lean >= 0 and not self.story else 0.0), True
        elif names and CONTENT_WORDS.search(names):
            self.lean += 1.0


class Block:
    __slots__ = ("text", "node", "link_chars")

    def __init__(self, text: str, node: Node, link_chars: int):
        self.text, self.node, self.link_chars = text, node, link_chars


class TagEnds:
    """Ends of tags, found in time linear in the page however its quotes and brackets are (mis)placed.

    A tag's end is the first ``>`` outside quotes. Where none follows, the tag is text. After the first such tag the search
    notes the quotes it came by in vain: a later search that comes by one of them ends there.
    """

    def __init__(self, page: str):
        self.page, self.last, self.vain = page, {c: page.rfind(c) for c in ">\"'"}, set()
        self.careful, self.mark_from, self.mark_at = False, 0, -1

    def find(self, start: int) -> int:
        """Position of the ``>`` that ends the tag whose name ends at ``start``; -1 if there is none."""
        if start > self.last[">"]:
            return -1
        if not self.careful:
            m = REST.match(self.page, start)
            if m:
                return m.end() - 1
            self.careful = True
        came, at = [], start
        while True:
            if not self.mark_from <= at <= self.mark_at:
                m = MARK.search(self.page, at)
                self.mark_from, self.mark_at = at, m.start() if m else len(self.page)
            k = self.mark_at
            if k == len(self.page) or k in self.vain:
                break
            c = self.page[k]
            if c == ">":
                return k
            came.append(k)
            if k >= self.last[c]:
                break
            at = self.page.index(c, k + 1) + 1
        self.vain.update(came)
        return -1


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, one scan over its tags."""
    root = Node("#", None)
    node, out, parts, links, at, end = root, [], [], 0, 0, len(page)

    def text(upto: int) -> None:
        nonlocal links
        if upto > at and not node.embedded:
            raw = page[at:upto]
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if node.link:
                links += len(raw)

    def flush() -> None:
        nonlocal links
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                out.append(Block(joined, node.block, links))
            parts.clear()
            links = 0

    def enter(tag: str, attrs: str) -> None:
        nonlocal node
        node = Node(tag, node, attrs)
        open_[tag] = open_.get(tag, 0) + 1

    def leave(to: Node) -> None:
        """Ends all elements below ``to``."""
        nonlocal node
        while node is not to:
            open_[node.tag] -= 1
            node = node.up

    def close(tag: str) -> None:
        if open_.get(tag):
            n = node
            while n.tag != tag:
                n = n.up
            leave(n.up)

    def inside(tags: set[str], stop: set[str]) -> str | None:
        if not any(open_.get(t) for t in tags):
            return None
        n = node
        while n.up:
            if n.tag in tags:
                return n.tag
            if n.tag in stop:
                return None
            n = n.up
        return None

    lower, ends = page.lower(), {}

    def closed(tag: str) -> bool:
        """Whether an end tag of this kind follows."""
        if tag not in ends:
            ends[tag] = max((e.start() for e in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", lower)), default=-1)
        return ends[tag] >= pos

    def end_embedded() -> None:
        """Ends the open embedded elements that cannot hold a section or heading."""
        n, top = node, None
        while n.embedded and n.tag not in HOLDS_FLOW:
            top = n if n.tag in EMBEDDED else top
            n = n.up
        if top is not None and not n.embedded:
            leave(top.up)

    pos, tag_ends, open_ = 0, TagEnds(page), {}
    while (m := TOKEN.search(page, pos)) is not None:
        tag = m[2]
        if tag is None:
            text(m.start())
            at = pos = m.end()
            continue
        close_at = tag_ends.find(m.end())
        if close_at < 0:
            pos = m.start() + 1
            continue
        text(m.start())
        attrs = page[m.end():close_at]
        at = pos = close_at + 1
        tag = tag.lower()
        if tag in EMBEDDED:
            # phrasing elements do not end the block they stand in
            if tag not in ("button", "select", "svg", "annotation", "annotation-xml"):
                flush()
            if m[1]:
                close(tag)
            elif not attrs.rstrip().endswith("/") and closed(tag):
                enter(tag, attrs)
            continue
        if node.embedded:
            if m[1]:
                if not open_.get(tag):
                    continue
                n = node
                while n.embedded and n.tag != tag:
                    n = n.up
                if n.embedded:
                    leave(n.up)
                    continue
                # an end tag of an element around the embedded one ends both
                while n.up and n.tag != tag:
                    n = n.up
                if not n.up:
                    continue
            else:
                if tag in ENDS_EMBEDDED:
                    end_embedded()
                if node.embedded and tag not in RAW:
                    if tag not in VOID and not attrs.rstrip().endswith("/"):
                        enter(tag, "")
                    continue
        if m[1]:
            if tag == "p" and inside({"p"}, {"article", "body", "div", "section", "td"}) is None:
                flush()
            elif tag not in VOID:
                if tag not in INLINE:
                    flush()
                    if tag == "body" or tag == "html":
                        continue
                close(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "head":
            flush()
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, pos)
            at = pos = stop.end()
            flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            # a new block ends inline elements left open in the last one, and an open paragraph
            n = node
            while n.up and n.tag in INLINE:
                n = n.up
            leave(n)
            if tag in CLOSES_P and inside({"p"}, {"table", "td", "th", "button", "object"}):
                close("p")
            if tag in ENDS_AT:
                names, stop_tags = ENDS_AT[tag]
                while (old := inside(set(names.split()), stop_tags)) is not None:
                    close(old)
        enter(tag, attrs)
    text(end)
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost if called boilerplate, cost if called content): a logistic score of the block's features, as -log p."""
    n = len(b.text)
    density = min(1.0, b.link_chars / n)
    score = b.node.lean + 0.9 * math.log1p(n) - 3.6 - 5.0 * density
    score += 0.8 if b.text[-1:] in ".!?:;…。\"”’)" else 0.0
    if b.node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 1.0
    elif b.node.tag == "p":
        score += 1.0
    elif b.node.tag in ("td", "th", "li", "label", "legend"):
        score -= 0.5
    soft = lambda x: x if x > 30 else math.log1p(math.exp(x))
    return soft(score), soft(-score)


def dom_distance(a: Node, b: Node) -> int:
    """Steps over the tree from element to element."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


class Graph:
    """Max-flow by shortest augmenting paths from terminal ``s`` to terminal ``t``."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.out = n, [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def _levels(self, s: int) -> list[int]:
        level, queue = [-1] * self.n, deque([s])
        level[s] = 0
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.cap[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Saturate, then say which nodes ``s`` still reaches."""
        while (level := self._levels(s))[t] >= 0:
            at = [0] * self.n
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    flow = min(self.cap[e] for e in path)
                    for k, e in enumerate(path):
                        self.cap[e] -= flow
                        self.cap[e ^ 1] += flow
                    cut = next(k for k, e in enumerate(path) if self.cap[e] <= 1e-12)
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    if self.cap[e] > 1e-12 and level[self.to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(self.out[x]):
                    path.append(self.out[x][at[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break
        return [v >= 0 for v in self._levels(s)]


def label(blocks: list[Block]) -> list[bool]:
    """True for content, by the minimum cut."""
    n = len(blocks)
    g, last = Graph(n + 2), {}
    for k, b in enumerate(blocks):
        boiler, content = costs(b)
        g.edge(n, k, boiler)
        g.edge(k, n + 1, content)
        if k:
            w = SMOOTH * math.exp(-FALL * max(0, dom_distance(blocks[k - 1].node, b.node) - 1))
            g.edge(k - 1, k, w, w)
        up = b.node.up or b.node
        if (old := last.get(id(up))) is not None and old < k - 1:
            w = SMOOTH * math.exp(-FALL * (1 + math.log1p(k - old)))
            g.edge(old, k, w, w)
        last[id(up)] = k
    return g.source_side(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    """The article's text: content blocks in page order."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, c in zip(blocks, label(blocks), strict=True) if c)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages (page_id, url, html)``."""
    prepare(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars long")

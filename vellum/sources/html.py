"""Text of web pages.  Parsing a tree is the one step that needs Python; all else is columns."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------
STRIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe", "figure", "button"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "pre"}
CONTAINERS = ["article", "main", "[role=main]", "#content", ".post", "body"]
# -----------------------------------------------------------------------------------------
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = BLOCKS - {"li"} | {"div", "article", "section", "nav", "header", "footer", "aside", "main", "ul", "ol", "table", "form", "figure", "hr"}


class _Node:
    __slots__ = ("name", "attrs", "parts", "up", "stripped", "holds")

    def __init__(self, name: str, attrs: dict, up: _Node | None):
        self.name, self.attrs, self.up, self.parts = name, attrs, up, []
        #: stands inside furniture; holds a block
        self.stripped = up is not None and (up.stripped or up.name in STRIP)
        self.holds = False

    def walk(self):
        """All nodes below, in document order, however deep they nest."""
        stack = [iter(self.parts)]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, _Node):
                yield part
                stack.append(iter(part.parts))

    def text(self) -> str:
        found, stack = [], [iter(self.parts)]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, _Node):
                stack.append(iter(part.parts))
            else:
                found.append(part)
        return "".join(found)


class _Tree(HTMLParser):
    """A forgiving tree: void tags, implied ends of paragraphs and items, stray end tags."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("body", {}, None)
        self.open: Counter = Counter()
        self.feed(page)
        self.close()

    def _leave(self, name: str, stop: set[str]) -> None:
        if not self.open[name]:
            return
        node = self.at
        while node is not None and node.name not in stop:
            if node.name == name and node.up is not None:
                while self.at is not node.up:
                    self.open[self.at.name] -= 1
                    self.at = self.at.up
                return
            node = node.up

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in _CLOSES_P:
            self._leave("p", {"article", "div", "li", "td"} - {tag})
        if tag == "li":
            self._leave("li", {"ul", "ol"})
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag in BLOCKS:
            up = self.at
            while up is not None and not up.holds:
                up.holds, up = True, up.up
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._leave(tag, set())

    def handle_data(self, data):
        self.at.parts.append(data)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def clean(text: str) -> str | None:
    """One line of text, or None with fewer than three letters."""
    one = squeeze(text)
    return one if sum(map(str.isalpha, one)) >= 3 else None


def _is(node: _Node, selector: str) -> bool:
    if selector == "[role=main]":
        return node.attrs.get("role") == "main"
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    if selector[0] == ".":
        return selector[1:] in node.attrs.get("class", "").split()
    return node.name == selector


def _navigation(node: _Node) -> bool:
    size = len(squeeze(node.text()).encode())
    linked = sum(len(squeeze(x.text()).encode()) for x in node.walk() if x.name == "a")
    return size == 0 or linked / size >= 0.8


def paragraphs(page: str, anchors: dict[str, str] | None = None) -> list[tuple[str, bool]]:
    """(text, is heading) of a page in reading order, from the first container that holds two.

    Leaf blocks outside furniture count, unless their text is mostly links.  ``anchors`` maps
    element ids to labels that come before the text at that place, each once.
    """
    root, anchors = _Tree(page).root, anchors or {}
    for selector in CONTAINERS:
        box = root if selector == "body" else next((n for n in root.walk() if _is(n, selector)), None)
        if box is None:
            continue
        found: list[tuple[str, bool]] = []
        told: set[str] = set()
        for node in box.walk():
            label = anchors.get(node.attrs.get("id", ""))
            if label and label not in told:
                told.add(label)
                found.append((label, True))
            if node.name not in BLOCKS or node.holds or node.stripped or _navigation(node):
                continue
            if text := clean(node.text()):
                found.append((text, bool(re.fullmatch("h[1-6]", node.name))))
        if len(found) >= 2:
            return found
    return []


def contents_links(page: str) -> list[tuple[str, str]]:
    """(target, label) of the links of a navigation document's table of contents."""
    root = _Tree(page).root
    navs = [n for n in root.walk() if n.name == "nav"]
    own = [n for n in navs if "toc" in n.attrs.get("epub:type", "").split()] or navs[:1]
    return [(x.attrs.get("href", ""), squeeze(x.text())) for n in own for x in n.walk() if x.name == "a" and x.attrs.get("href")]


def title(page: str) -> str | None:
    """The first article heading, heading or title that is text."""
    root = _Tree(page).root
    headed: set[int] = set()
    for node in root.walk():
        up = node.up if node.name == "h1" else None
        while up is not None and id(up) not in headed:
            headed.add(id(up))
            up = up.up
    article = next((n for n in root.walk() if n.name == "article" and id(n) in headed), None)
    for box, name in ((article, "h1"), (root, "h1"), (root, "title")):
        node = next((n for n in box.walk() if n.name == name), None) if box else None
        if node and (text := clean(node.text())):
            return text
    return None


def web_paragraphs(pages: DataFrame) -> DataFrame:
    """``page_id, url, title, ordinal, text, is_heading`` from ``page_id, url, html``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for page_id, url, page in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                name = title(page or "")
                rows += [(page_id, url, name, i, text, head) for i, (text, head) in enumerate(paragraphs(page or ""), 1)]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["page_id", "url", "title", "ordinal", "text", "is_heading"],
                )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, title string, ordinal long, text string, is_heading boolean"
    )


#: More links than this, and more than this share of its paragraphs, make a page look like navigation.
MANY_LINKS, LINK_SHARE = 20, 0.5
OPENING = 110


def page_shapes(pages: DataFrame) -> DataFrame:
    """``page_id, paragraphs, size, longest, links, opening, navigation`` from ``page_id, url, html``.

    ``size`` counts the bytes of the paragraphs that are read, ``longest`` the characters of
    the longest one; ``opening`` is how the first begins.  ``page_id`` must be unique; a page
    without reading text has zeros and no opening.
    """
    own = web_paragraphs(pages).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.octet_length("text")).alias("size"), F.max(F.length("text")).cast("long").alias("longest"),
        F.min_by(F.substring("text", 1, OPENING), "ordinal").alias("opening"),
    )
    links = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_count("html", F.lit("<a ")), F.lit(0)).cast("long").alias("links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = links.join(own, "page_id", "left").select("page_id", zero("paragraphs"), zero("size"), zero("longest"), "links", "opening")
    return out.withColumn("navigation", (F.col("links") > MANY_LINKS) & (F.col("links") > LINK_SHARE * F.col("paragraphs")))

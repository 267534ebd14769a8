"""Web pages: search results, one row an element, and detail pages, one case each, by ordered fallbacks of selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ampersands that begin no reference with its semicolon.
_OPEN = re.compile(r"&(?!(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Fields of a detail page with the selectors tried in turn; `~text` takes the first match that holds the text.
DETAIL = {
    "case_name": ("h1.case-title", "blockquote > p > b", "h1", "h2", "title"), "citation": (".citation", "p~["), "court": (".court",), "decided": (".judgment-date", "p~Date:"),
    "judges": (".judge", "p~Before:"), "body": (".judgment-body", "ol[type=1]", "article", "blockquote", "body"),
}


class Node:
    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.children)
        return re.sub(r"\s+", " ", " ".join(out)).strip()


class _Tree(HTMLParser):
    """A forgiving tree: void elements don't nest, an end tag closes up to its start, a paragraph closes the one before."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.nodes: list[Node] = []

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None, closed: bool = False) -> list[Node]:
    """closed: character references count only with their semicolon; browsers also read some, as `&amp`, without it."""
    tree = _Tree()
    tree.feed(_OPEN.sub("&amp;", html or "") if closed else html or "")
    tree.close()
    return tree.nodes


@cache
def _read(selector: str) -> tuple[str, tuple[str, ...], str | None, str | None]:
    """Tag, classes, attribute and value of a selector without >; a tag that nothing has, if it can't be read."""
    m = re.fullmatch(r"([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)=['\"]?([^'\"\]]*)['\"]?\])?", selector)
    tag, classes, attr, value = m.groups() if m else ("?", "", None, None)
    return tag, tuple(classes.split(".")[1:]), attr, value


def _simple(node: Node, selector: tuple[str, tuple[str, ...], str | None, str | None]) -> bool:
    tag, classes, attr, value = selector
    if tag and node.tag != tag:
        return False
    own = node.attrs.get("class", "").split() if classes else ()
    return all(c in own for c in classes) and (attr is None or node.attrs.get(attr) == value)


def _matches(nodes: list[Node], selector: str) -> Iterator[Node]:
    selector, _, holds = selector.partition("~")
    *above, last = [_read(s.strip()) for s in selector.split(">")]
    for x in nodes:
        at, ok = x, _simple(x, last)
        if not ok:
            continue
        for s in reversed(above):
            at = at.parent if at is not None else None
            ok = ok and at is not None and _simple(at, s)
        if ok and (not holds or holds in x.text()):
            yield x


def select(nodes: list[Node], selector: str) -> list[Node]:
    """Nodes in document order: tag, .class, [attr=value], a > b, and ~text."""
    return list(_matches(nodes, selector))


def details(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fields: dict[str, tuple[str, ...]] | None = None, closed: bool = False) -> DataFrame:
    """id, then each field: the text of the first node of the first selector that finds any; null if none does. Null
    pages: nulls. Pages are parsed whole, some at a time; closed: as in parse."""
    fields = fields or DETAIL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = []
                for html in part.column(1).to_pylist():
                    nodes = parse(html, closed)
                    rows.append([next((x.text() for s in selectors for x in _matches(nodes, s)), None) for selectors in fields.values()])
                columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *fields])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col)).mapInArrow(run, "id long, " + ", ".join(f"{f} string" for f in fields))


def results(pages: DataFrame, element: str, limit: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, place (from 0), title, url of each element's first link, or of itself where it is one; limit: per page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = select(parse(html), element)
                for place, x in enumerate(found[:limit] if limit else found):
                    todo = [x]
                    link = None
                    while todo and link is None:
                        y = todo.pop(0)
                        link = y if y.tag == "a" else None
                        todo = [c for c in y.children if isinstance(c, Node)] + todo
                    rows.append((one, place, (link or x).text(), None if link is None else link.attrs.get("href")))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["id", "place", "title", "url"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col)).mapInArrow(run, "id long, place int, title string, url string")

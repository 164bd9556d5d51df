"""HTML as flat relations. The tree lives only inside one Arrow pass; what comes out are rows and strings.

Tree rules: void elements never open; an end tag closes the nearest open element of its name, or is ignored; script
and style hold raw text; a start tag closes nothing implicitly.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import ship

# The block elements that are extracted, paragraph-like elements, void elements, dropped elements.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol")
PARAGRAPHS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = ("script", "iframe", "link", "meta", "style")

_SPACE = re.compile(r"\s+")


class _Tree(HTMLParser):
    """Events to sinks: ``on_text(text, kind)`` with the stack of open (tag, id) pairs at hand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.count = 0
        self.opened: list[str] = []
        self.texts: list[tuple[tuple[int, ...], str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.stack.append((tag, self.count))
            self.opened.append(tag)
            self.count += 1

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID:
            self.opened.append(tag)
            self.count += 1

    def handle_endtag(self, tag):
        for up in range(len(self.stack) - 1, -1, -1):
            if self.stack[up][0] == tag:
                del self.stack[up:]
                return

    def _add(self, text: str, kind: str) -> None:
        self.texts.append((tuple(i for _, i in self.stack), text, kind))

    def handle_data(self, data):
        raw = bool(self.stack) and self.stack[-1][0] in ("script", "style")
        self._add(data, "raw" if raw else "text")

    def handle_comment(self, data):
        self._add(data, "comment")


def _parsed(source: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(source or "")
    tree.close()
    return tree


def elements_of(source: str | None) -> list[dict]:
    """Block elements in document order; a text belongs to its nearest block element only."""
    tree = _parsed(source)
    numbers = {node: i for i, node in enumerate(n for n, tag in enumerate(tree.opened) if tag in BLOCKS)}
    parts: dict[int, list[str]] = {node: [] for node in numbers}
    for nodes, text, kind in tree.texts:
        if kind == "text" and (own := next((n for n in reversed(nodes) if n in numbers), None)) is not None:
            parts[own].append(text)
    return [{"elem_id": i, "tag": tree.opened[n], "text": _SPACE.sub(" ", "".join(parts[n]))} for n, i in numbers.items()]


def paragraphs_of(source: str | None) -> str:
    """All strings below each paragraph-like element, nested ones again, comments and raw text included."""
    tree = _parsed(source)
    found: list[str] = []
    for node, tag in enumerate(tree.opened):
        if tag in PARAGRAPHS:
            found += [text for nodes, text, _ in tree.texts if node in nodes]
    return re.sub("\n+", "\n", "\n".join(found))


def text_of(source: str | None) -> str:
    """Text of the page without comments, scripts and styles."""
    return "".join(text for _, text, kind in _parsed(source).texts if kind == "text")


def _udf(function, kind):
    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(function)

    return run


def elements(html: Column) -> Column:
    """Block elements as array<struct<elem_id, tag, text>>, in document order."""
    return _udf(elements_of, "array<struct<elem_id:int,tag:string,text:string>>")(html)


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a block element: the other columns, elem_id (dense, in document order), tag, text."""
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(elements(F.col(html))).alias("e")).select(*rest, "e.elem_id", "e.tag", "e.text")


def paragraph_text(html: Column) -> Column:
    return _udf(paragraphs_of, "string")(html)


def plain_text(html: Column) -> Column:
    return _udf(text_of, "string")(html)


def strip_tags(html: Column) -> Column:
    """Without scripts, frames, links, metadata and styles, by pattern."""
    for tag in ("script", "iframe", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(html, r"(?is)<(?:link|meta)\b[^>]*>", "")

"""Page texts, links, titles and dates from HTML, in one Arrow-batched pass over the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is dropped, elements that make a line, elements that never close.
DROPPED = ("script", "style", "nav", "aside", "form", "noscript")
BLOCKS = ("h1", "h2", "h3", "h4", "p", "li", "tr", "dt", "dd")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def strings(self, without: tuple[str, ...] = ()) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in without:
                stack.extend(reversed(x.children))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self._open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "tr", "dt", "dd") and self._open[-1].tag == tag:
            self._open.pop()  # left open by the author
        node = Node(tag, {k: v or "" for k, v in attrs})
        self._open[-1].children.append(node)
        if tag not in VOID:
            self._open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                del self._open[i:]
                return

    def handle_data(self, data: str) -> None:
        self._open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def main_part(root: Node) -> Node:
    """The main element, else a known container, else the body, else everything."""
    nodes = list(root.walk())
    for test in (lambda n: n.tag == "main", lambda n: n.attrs.get("id") in ("container", "wb-cont"), lambda n: n.tag == "body"):
        found = next((n for n in nodes if test(n)), None)
        if found is not None:
            return found
    return root


def _squeezed(parts: Iterator[str], sep: str = " ") -> str:
    return " ".join(sep.join(parts).split())


def text_lines(main: Node) -> str:
    """A line for each block in document order: headings marked with #, items with -, cells joined by |.

    A block within another gives its text in both; a line like the one before is dropped.
    """
    lines: list[str] = []

    def visit(node: Node) -> None:
        if node.tag in DROPPED:
            return
        if node.tag in BLOCKS:
            if node.tag == "tr":
                cells = [_squeezed(c.strings(DROPPED)) for c in node.walk() if c.tag in ("td", "th")]
                line = " | ".join(c for c in cells if c)
            else:
                line = _squeezed(node.strings(DROPPED))
            if line:
                mark = {"h1": "\n# ", "h2": "\n## ", "h3": "\n### ", "h4": "\n#### ", "li": "- "}.get(node.tag, "")
                if not lines or lines[-1] != mark + line:
                    lines.append(mark + line)
        for child in node.children:
            if isinstance(child, Node):
                visit(child)

    visit(main)
    return "\n".join(lines).strip()


def links(main: Node, base: str | None) -> list[str]:
    """All targets under the main part, navigation included, absolute, in order."""
    out = []
    for n in main.walk():
        if n.tag == "a" and n.attrs.get("href", "").strip():
            try:
                out.append(urljoin(base or "", n.attrs["href"].strip()))
            except ValueError:
                continue
    return out


def date_modified(root: Node) -> str | None:
    for n in root.walk():
        if n.attrs.get("property", "").lower() == "datemodified" or (n.tag == "time" and "datetime" in n.attrs):
            found = re.search(r"\d{4}-\d{2}-\d{2}", " ".join([n.attrs.get("content", ""), n.attrs.get("datetime", ""), _squeezed(n.strings())]))
            if found:
                return found.group()
    return None


def extract(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, title, date_modified, text, links, n_chars). Null or broken HTML gives what can be read, at worst ''."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, u, h in zip(pdf["k"], pdf["u"], pdf["h"], strict=True):
                root = parse(h)
                main = main_part(root)
                title = next((_squeezed(n.strings()) for n in root.walk() if n.tag == "title"), None)
                text = text_lines(main)
                rows.append((k, title, date_modified(root), text, links(main, u), len(text)))
            yield pd.DataFrame(rows, columns=["key", "title", "date_modified", "text", "links", "n_chars"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    return rows.mapInPandas(run, f"key {kind}, title string, date_modified string, text string, links array<string>, n_chars int").withColumnRenamed("key", key)

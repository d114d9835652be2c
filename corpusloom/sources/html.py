"""Nodes of HTML pages as rows, with filters over tags and attributes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that have no content, so no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

SHAPE = "page_id long, ord long, depth long, tag string, attributes map<string,string>, text string"
COLUMNS = ["page_id", "ord", "depth", "tag", "attributes", "text"]


#: Characters (and places of rows) that go to the JVM at once.
CHUNK = 1 << 20


class _Nodes(HTMLParser):
    """Elements in document order with the text inside them; scripts and styles have none. A page's pieces of text are held once, and each element's first and end among them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append([len(self.nodes), len(self.open), tag, {k: v or "" for k, v in attrs}, len(self.pieces), len(self.pieces)])
        if tag == "br":
            self.handle_data(" ")
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]][2] == tag:
                self._end(i)
                return

    def handle_data(self, data):
        if not any(self.nodes[i][2] in ("script", "style") for i in self.open):
            self.pieces.append(data)

    def close(self):
        super().close()
        self._end(0)

    def _end(self, i):
        for n in self.open[i:]:
            self.nodes[n][5] = len(self.pieces)
        del self.open[i:]

    def text(self, node):
        return " ".join("".join(self.pieces[node[4] : node[5]]).split())


def _rows(only: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for page, html in zip(batch.page_id, batch.html, strict=True):
                parser = _Nodes()
                parser.feed(html or "")
                parser.close()  # text that waited for a reference or tag to end
                for node in parser.nodes:
                    n, d, t, a = node[:4]
                    if not only or t in only:
                        rows.append((page, n, d, t, a, parser.text(node)))
                        held += len(rows[-1][5]) + sum(len(k) + len(v) for k, v in a.items()) + 256
                    if held >= CHUNK:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def html_nodes(pages: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, ord, depth, tag, attributes, text) of each element; only: tags to return. Null html has none; broken html gives what the parser finds.

    Rows go on in chunks of about CHUNK characters, within a page too, so a worker holds a chunk and not what a batch of pages yields.
    """

    return pages.select("page_id", "html").mapInPandas(_rows(only), SHAPE)


def has_tag(tag: str) -> Column:
    return F.col("tag") == tag


def has_attribute(name: str, value: str | None = None) -> Column:
    """The attribute is there, with this value if one is given. Filters join by & and |."""
    at = F.element_at("attributes", name)
    return at.isNotNull() if value is None else F.coalesce(at == value, F.lit(False))

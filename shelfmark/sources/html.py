"""HTML pages as text and tables, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Markup that structures text.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "br", "pre", "blockquote", "tr", "div", "section", "article", "table", "title")
HIDDEN = ("script", "style", "noscript", "template")
NO_IMAGE = "[External or missing image; inspect original]"


class _Page(HTMLParser):
    def __init__(self, images: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.images, self.parts, self.hidden = images, [], 0
        self.tables: list[list[list[tuple]]] = []
        self.open: list[dict] = []
        self.warnings: set[str] = set()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "img":
            if a.get("src") in self.images:
                self.handle_data(f"![{a.get('alt') or 'Embedded source image'}]({a['src']})")
            else:
                self.warnings.add("EXTERNAL_OR_MISSING_IMAGE")
                self.handle_data(NO_IMAGE)
        elif tag == "table":
            if self.open:
                self.warnings.add("NESTED_TABLE_REQUIRES_REVIEW")
            self.open.append({"rows": [], "cell": None})
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            self.open[-1]["cell"] = (tag == "th", self._span(a.get("rowspan")), self._span(a.get("colspan")), [])
        if tag in BLOCKS:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th", "tr") and self.open:
            self._close_cell()
        elif tag == "table" and self.open:
            self._close_cell()
            t = self.open.pop()
            if not self.open:
                self.tables.append(t["rows"])
        if tag in BLOCKS:
            self.handle_data("\n")

    @staticmethod
    def _span(v: str | None) -> int:
        return int(v) if v and v.isdigit() and int(v) > 0 else 1

    def _close_cell(self):
        t = self.open[-1] if self.open else None
        if t and t["cell"]:
            head, rs, cs, parts = t["cell"]
            if not t["rows"]:
                t["rows"].append([])
            t["rows"][-1].append((rs, cs, "".join(parts).strip(), head))
            t["cell"] = None

    def handle_data(self, data):
        if self.hidden:
            return
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][3].append(data)
        elif not self.open:
            self.parts.append(data)


def page_of(html: str, images: frozenset[str] = frozenset()) -> tuple[str, list, list[str]]:
    """(text, tables as rows of (rowspan, colspan, text, header), sorted warnings) of one HTML page."""
    p = _Page(images)
    p.feed(html)
    p.close()
    text = re.sub(r"[^\S\n]+", " ", "".join(p.parts))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip(), p.tables, sorted(p.warnings)


def html_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, text, n_tables, warnings of HTML pages; null pages are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [page_of(x) for x in pdf[html]]
            yield pd.DataFrame({key: pdf[key], "text": [t for t, _, _ in found], "n_tables": [len(x) for _, x, _ in found], "warnings": [w for _, _, w in found]})

    return df.filter(df[html].isNotNull()).select(key, html).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, text string, n_tables int, warnings array<string>")


def html_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, r, i, rowspan, colspan, text, header: table rows for ``operators.tables.place_in_grid``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, r, i, *c) for k, x in zip(pdf[key], pdf[html], strict=True) for n, t in enumerate(page_of(x)[1], 1) for r, row in enumerate(t) for i, c in enumerate(row)]
            yield pd.DataFrame(rows, columns=[key, "table_no", "r", "i", "rowspan", "colspan", "text", "header"])

    return df.filter(df[html].isNotNull()).select(key, html).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, table_no int, r int, i int, rowspan int, colspan int, text string, header boolean")

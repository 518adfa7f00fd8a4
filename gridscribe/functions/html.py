"""Tables, records and links of web pages: one pass over the tags of a page, tolerant of what is not closed."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Fixed by the standard: a cell spans so many columns and rows at most.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SKIPPED = {"script", "style", "template", "noscript"}
_HEADINGS = {"h1", "h2", "h3"}
#: An ampersand that begins none of the three references by which text is kept apart from markup.
_OTHER_REFERENCE = re.compile(r"&(?!(?:amp|lt|gt);)")
#: Elements that are a record of a listing, and classes that make another element one.
_RECORDS, _RECORD_CLASSES = {"article"}, {"views-row", "trial-result-row"}


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Grid:
    """Rows of a table, where a cell fills all places that it spans."""

    def __init__(self):
        self.caption: list[str] = []
        self.rows: list[dict[int, str]] = []
        self.open: dict[int, tuple[int, str]] = {}  # column: rows that a cell from above still fills, and its text
        self.row: dict[int, str] | None = None
        self.cell: tuple[list[str], int, int] | None = None

    def begin_row(self) -> None:
        self.end_row()
        self.row = {c: text for c, (_, text) in self.open.items()}
        self.open = {c: (n - 1, text) for c, (n, text) in self.open.items() if n > 1}

    def begin_cell(self, columns: int, rows: int) -> None:
        self.end_cell()
        if self.row is None:
            self.begin_row()
        self.cell = ([], columns, rows)

    def end_cell(self) -> None:
        if self.cell is None:
            return
        parts, columns, rows = self.cell
        self.cell, text, at = None, _squeezed(parts), 0
        while at in self.row:
            at += 1
        for c in range(at, at + columns):
            if c in self.row:
                break  # what a cell from above holds stays its own
            self.row[c] = text
            if rows > 1:
                self.open[c] = (rows - 1, text)

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self.rows.append(self.row)
        self.row = None

    def done(self) -> dict:
        self.end_row()
        width = max((max(r, default=-1) + 1 for r in self.rows), default=0)
        return {"caption": _squeezed(self.caption), "rows": [[r.get(c, "") for c in range(width)] for r in self.rows]}


class Page(HTMLParser):
    """Finds tables (nested ones too, in the order in which they begin), records with title, links and text, and all links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[Grid] = []
        self.inside: list[Grid] = []
        self.records: list[dict] = []
        self.record: list[tuple[str, int, dict]] = []
        self.links: list[dict] = []
        self.link: tuple[dict, list[str]] | None = None
        self.skip, self.heading, self.caption, self.depth = 0, 0, False, 0

    @staticmethod
    def _span(attrs: dict, name: str, most: int) -> int:
        text = (attrs.get(name) or "").strip()
        n = int(text) if text.isascii() and text.isdigit() and len(text) < 9 else 1
        return most if not n and name == "rowspan" else min(max(n, 1), most)

    def handle_starttag(self, tag, attributes):
        attrs = dict(attributes)
        if tag in ("tr", "td", "th", "table"):
            self.caption = False
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "table":
            self.inside.append(Grid())
            self.tables.append(self.inside[-1])
        elif tag == "a":
            self._end_link()
            self.link = ({"url": attrs.get("href") or ""}, [])
        elif tag in _HEADINGS:
            self.heading += 1
        elif self.inside and tag == "tr":
            self.inside[-1].begin_row()
        elif self.inside and tag in ("td", "th"):
            self.inside[-1].begin_cell(self._span(attrs, "colspan", MOST_COLUMNS), self._span(attrs, "rowspan", MOST_ROWS))
        elif self.inside and tag == "caption":
            self.caption = True
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")
        if tag in _RECORDS or _RECORD_CLASSES & set((attrs.get("class") or "").split()):
            self.record.append((tag, self.depth, {"title": [], "text": [], "links": [], "titled": False}))
        if self.record and tag == self.record[-1][0]:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.inside:
            self.inside.pop().end_row()
        elif tag == "a":
            self._end_link()
        elif tag in _HEADINGS:
            self.heading = max(0, self.heading - 1)
            for _, _, r in self.record:
                r["titled"] = r["titled"] or bool(_squeezed(r["title"]))
        elif tag == "tr" and self.inside:
            self.inside[-1].end_row()
        elif tag in ("td", "th") and self.inside:
            self.inside[-1].end_cell()
        elif tag == "caption":
            self.caption = False
        if self.record and tag == self.record[-1][0]:
            self.depth -= 1
            if self.depth <= self.record[-1][1]:
                self._end_record()

    def handle_data(self, data):
        if self.skip:
            return
        if self.inside:
            grid = self.inside[-1]
            if self.caption:
                grid.caption.append(data)
            elif grid.cell is not None:
                grid.cell[0].append(data)
        if self.link is not None:
            self.link[1].append(data)
        for _, _, r in self.record:
            r["text"].append(data)
            if self.heading and not r["titled"]:
                r["title"].append(data)

    def _end_link(self):
        if self.link is not None:
            link = {**self.link[0], "label": _squeezed(self.link[1])}
            self.links.append(link)
            for _, _, r in self.record:
                r["links"].append(link)
        self.link = None

    def _end_record(self):
        _, _, r = self.record.pop()
        self.records.append({"title": _squeezed(r["title"]), "text": _squeezed(r["text"]), "links": r["links"]})

    def done(self) -> dict:
        self.close()
        self._end_link()
        while self.record:
            self._end_record()
        return {"tables": [g.done() for g in self.tables], "records": self.records, "links": self.links}


def read_page(html: str | None, as_written: bool = False) -> dict:
    """All references are read as browsers read them, also without a semicolon; as_written: `&amp;`, `&lt;` and `&gt;` alone, whole, and others stay as they stand."""
    page = Page()
    page.feed(_OTHER_REFERENCE.sub("&amp;", html or "") if as_written else html or "")
    return page.done()


_TEXT = StringType()
_LINKS = ArrayType(StructType([StructField("url", _TEXT), StructField("label", _TEXT)]))
PAGE = StructType([
    StructField("tables", ArrayType(StructType([StructField("caption", _TEXT), StructField("rows", ArrayType(ArrayType(_TEXT)))]))),
    StructField("records", ArrayType(StructType([StructField("title", _TEXT), StructField("text", _TEXT), StructField("links", _LINKS)]))),
    StructField("links", _LINKS),
])


@F.pandas_udf(PAGE)
def parsed_page(html: pd.Series) -> pd.DataFrame:
    """tables (caption; rows of cells, spans filled), records (title, text, links) and links of each page, in Arrow batches; empty for a null."""
    return pd.DataFrame([read_page(h) for h in html], columns=["tables", "records", "links"])


@F.pandas_udf(PAGE)
def page_as_written(html: pd.Series) -> pd.DataFrame:
    """parsed_page that reads no reference but those of markup: titles cut within a reference and quotes stay as they stand."""
    return pd.DataFrame([read_page(h, True) for h in html], columns=["tables", "records", "links"])

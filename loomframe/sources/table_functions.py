"""Table functions for SQL: the links, blocks and table cells of a page, by LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomframe.sources.html import Page, read_page

BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "dt", "dd", "blockquote", "pre", "figcaption", "caption"}


def _text(page: Page, row: dict) -> str:
    return " ".join(t for t, *_ in page.pieces[row["low"] : row["high"]])


@udtf(returnType="node int, href string, text string, aside boolean", useArrow=True)
class HtmlLinks:
    """html_links(html): a row for each anchor with an address, in document order; aside: it stands in nav or footer. None of a null page."""

    def eval(self, html: str) -> Iterator[tuple]:
        page = read_page(html)
        for row in page.rows:
            if row["tag"] == "a" and "href" in row["attrs"]:
                yield row["node"], row["attrs"]["href"], _text(page, row), row["aside"]


@udtf(returnType="node int, tag string, depth int, text string, aside boolean", useArrow=True)
class HtmlBlocks:
    """html_blocks(html): a row for each heading, paragraph, list item, cell or the like that holds text, in document order.

    An element with such an element inside gives the text of both; blocks without text are left out.
    """

    def eval(self, html: str) -> Iterator[tuple]:
        page = read_page(html)
        for row in page.rows:
            if row["tag"] in BLOCKS and (text := _text(page, row)):
                yield row["node"], row["tag"], row["depth"], text, row["aside"]


@udtf(returnType="table int, row int, col int, header boolean, text string", useArrow=True)
class HtmlTableCells:
    """html_table_cells(html): a row for each cell; tables, rows and columns are numbered from 0, a nested table by itself.

    header: the cell is a ``th``.
    """

    def eval(self, html: str) -> Iterator[tuple]:
        page = read_page(html)
        rows = page.rows
        parent = {row["node"]: row for row in rows}
        tables: dict[int, int] = {}
        lines: dict[int, tuple[int, int]] = {}
        rows_of: dict[int, int] = {}
        cols_of: dict[int, int] = {}
        for row in rows:
            if row["tag"] == "table":
                tables[row["node"]] = len(tables)
            elif row["tag"] == "tr":
                up = parent.get(row["parent"])
                while up is not None and up["tag"] != "table":
                    up = parent.get(up["parent"])
                if up is not None:
                    table = tables[up["node"]]
                    lines[row["node"]] = table, rows_of.setdefault(table, 0)
                    rows_of[table] += 1
            elif row["tag"] in ("td", "th") and row["parent"] in lines:
                table, line = lines[row["parent"]]
                col = cols_of.get(row["parent"], 0)
                cols_of[row["parent"]] = col + 1
                yield table, line, col, row["tag"] == "th", _text(page, row)


FUNCTIONS = {"html_links": HtmlLinks, "html_blocks": HtmlBlocks, "html_table_cells": HtmlTableCells}


def register_table_functions(spark: SparkSession) -> None:
    """Makes ``html_links``, ``html_blocks`` and ``html_table_cells`` known to SQL: ``FROM pages, LATERAL html_links(html)``.

    Each call reads one page, so a task holds one page at a time; column pruning keeps all columns but those asked for out of the calls.
    """
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)

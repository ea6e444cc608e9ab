"""Character references in the queries on pages."""

import duckdb
import pandas as pd

import __spark_entry__ as entry
from test_queries import compare


def check(spark, tmp_path, name, html):
    """The query on these pages gives what its SQL gives."""
    pd.DataFrame({"page_id": range(len(html)), "url": "https://ex.org/", "html": html}).to_parquet(tmp_path / "pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    compare(entry.queries()[name](spark, str(tmp_path)), connection, entry.oracle_sql()[name])


HEADS = ["token = &quot", "A &amp; b &amp &am &a &", "&quot;c&quot; &amp;quot; &amp;amp;", "Peat &copy &middot &copy; &middot;", "&copyx &ampx &notit; &#65; &#x41 &eacute;", "R&D & more &lt &gt &AMP; &QUOT;"]


def test_unescape_with_cut_references(spark, tmp_path):
    """On the check tool's larger table, one title ended in &quot without its semicolon, which was resolved."""
    check(spark, tmp_path, "unescape_html", [*[f"<h1>{h}</h1><p>&lt;{h}&gt;</p>" for h in HEADS], "", None])


PAGES = [
    f"<html><head><title>{h}</title><style>p{{}}</style></head><body><article><h1>{h}</h1><p><b>{h}: </b><p>a {h} b<br>&lt;c&gt; {h}<p>{h} &quot;d&quot;</p></article><footer>&copy; {h}</footer></body></html>"
    for h in HEADS
]


def test_page_text_with_cut_references(spark, tmp_path):
    check(spark, tmp_path, "page_text", [*PAGES, None])


def test_page_tokens_with_cut_references(spark, tmp_path):
    check(spark, tmp_path, "page_tokens", [*PAGES, None])


def test_page_sections_with_cut_references(spark, tmp_path):
    check(spark, tmp_path, "page_sections", [*PAGES, None])


def test_page_blocks_with_cut_references(spark, tmp_path):
    """A reference without its semicolon, or one that the SQL does not name, stays as it is written."""
    heads = ["Soil &amp;&amp and &amp", "A &lt;b&gt; &quot;c&quot; &amp;lt;", "Peat &copy; &#65; &lt", "R&D & more"]
    html = [f"<html><body><h1>{h}</h1><ul><li>a &amp b</li><li>c</li></ul></body></html>" for h in heads]
    pd.DataFrame({"page_id": range(len(html)), "url": "https://ex.org/", "html": html}).to_parquet(tmp_path / "pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    compare(entry.queries()["sql_page_blocks"](spark, str(tmp_path)), connection, entry.oracle_sql()["sql_page_blocks"])

"""The page reader; what is made of its rows is tested by the queries over made-up pages."""

import pytest

import fixtures as fx
from loomframe.sources import html as ht


@pytest.fixture(scope="module")
def pages(spark):
    blank = spark.createDataFrame([("null", "https://ex.org/null", None), ("blank", "https://ex.org/blank", "")], "page_id string, url string, html string")
    return fx.pages(spark).union(blank)


@pytest.fixture(scope="module")
def nodes(pages):
    return ht.nodes_of(ht.parse_pages(pages).cache())


def test_nodes_nest(nodes):
    rows = nodes.where("page_id = 'linked'").collect()
    by = {r["node"]: r for r in rows}
    assert all(r["parent"] == -1 or by[r["parent"]]["node"] < r["node"] <= r["end"] <= by[r["parent"]]["end"] for r in rows)
    assert not nodes.where("page_id in ('null', 'blank')").count()


def test_long_pages_are_read_to_their_end(spark):
    page = "<p>" + "word " * 900_000 + "</p><a href='/last'>last</a>"
    rows = ht.page_nodes(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("node").collect()
    assert [r["tag"] for r in rows] == ["p", "a"] and rows[1]["lines"] == ["last"]


def test_unclosed_elements_cost_no_more(spark):
    page = "".join(f"<b>x{i}" for i in range(20_000))
    got = ht.page_nodes(spark.createDataFrame([(1, page)], "page_id int, html string")).where("tag = 'b'")
    assert got.count() == 20_000 and got.where("node = 0").first()["lines"][-1] == "x19999"

"""Results rerun by unit, snapshots by version, table functions and label containment."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomframe.operators import coverage as cv
from loomframe.operators import resolve as rs
from loomframe.sources import store as st
from loomframe.sources import table_functions as tf


def files(path):
    """The data files of each partition."""
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in Path(path).glob("unit_id=*")}


@pytest.fixture
def results(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i:02}", "error" if i in (3, 4, 5) else "ok") for i in range(25)], "unit_id string, status string")
    people = spark.createDataFrame([(f"u{i:02}", f"p{i}-{j}") for i in range(25) for j in range(i % 4)], "unit_id string, person string")
    path = str(tmp_path / "results")
    first = st.unit_results(units, people)
    st.write_results(first, path)
    return path, first.schema


def told(df):
    return sorted((r["unit_id"], r["status"], r["person"]) for r in df.collect() if r["person"] is not None)


def test_rerun_rewrites_the_units_that_gain(spark, results):
    path, schema = results
    before, was = files(path), told(st.read_results(spark, path, schema))
    assert {r[0] for r in st.failed_units(st.read_results(spark, path, schema)).collect()} == {"u03", "u04", "u05"}
    # u03: well, but with nobody; u04: failed again, with more people than the none before; u05: failed again, with as few as before
    again = spark.createDataFrame([("u03", "ok", None), ("u04", "error", "new"), ("u05", "error", "other")], "unit_id string, status string, person string")
    whole = st.rerun_units(again, path)
    after = files(path)
    assert {u for u in before if before[u] != after[u]} == {"unit_id=u03", "unit_id=u04"}
    kept = [r for r in was if r[0] not in ("u03", "u04")]
    assert told(whole) == sorted([*kept, ("u04", "error", "new")])
    assert whole.where("unit_id = 'u03'").select("status", "person").collect() == [("ok", None)]


def test_rerun_adds_and_ends(spark, results):
    path, schema = results
    whole = st.rerun_units(spark.createDataFrame([("new", "unreachable", None)], "unit_id string, status string, person string"), path)
    assert whole.select("unit_id").distinct().count() == 26
    before = files(path)
    assert st.rerun_units(spark.createDataFrame([], schema), path).count() == whole.count() and files(path) == before


ROWS = "id long, name string, tags array<string>"


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    assert st.load_meta(spark, root) is None and st.is_stale(None, "2026-10-10") and not st.manifest(spark, root).count()
    with pytest.raises(ValueError, match="nothing is published"):
        st.read_snapshot(spark, root)
    a = spark.createDataFrame([(1, "x", ["t"]), (2, None, None), (2, None, None)], ROWS)
    first = st.publish(a, root, {"k": "v"}, published_at="2026-01-01T00:00:00")
    assert st.publish(a.repartition(3), root) == {**first, "facts": {"k": "v"}}  # the same rows in another order
    second = st.publish(a.limit(2), root)
    assert (first["version"], second["version"], first["rows"], second["rows"]) == (1, 2, 3, 2) and len(first["revision"]) == 10
    assert sorted(map(str, st.read_snapshot(spark, root, version=1).collect())) == sorted(map(str, a.collect()))
    assert st.read_snapshot(spark, root, revision=first["revision"]).count() == 3 and st.read_snapshot(spark, root).count() == 2
    assert st.is_stale(first, "2026-04-21") and not st.is_stale(first, "2026-04-20")
    with pytest.raises(ValueError):
        st.read_snapshot(spark, root, version=9)
    (Path(root) / "manifest" / "000000000003.json").write_text("{broken")  # an entry that another writer did not finish
    assert st.load_meta(spark, root)["version"] == 2
    third = st.publish(spark.createDataFrame([], ROWS), root)
    assert third["version"] == 4 and st.read_snapshot(spark, root).columns == ["id", "name", "tags"]
    assert st.expire(spark, root, keep=1) == 2 and [r["version"] for r in st.manifest(spark, root).collect()] == [4]
    assert json.loads((Path(root) / "manifest" / "000000000004.json").read_text())["rows"] == 0


def test_revision_tells_content(spark):
    rows = [(1, "x", ["t"]), (2, "y", None)]
    revision = lambda r, cols=("id", "name", "tags"): st.content_revision(spark.createDataFrame(r, ROWS).select(*cols))
    assert revision(rows) == revision(rows[::-1]) == revision(rows, ("tags", "name", "id"))
    assert len({revision(rows), revision(rows[:1]), revision(rows * 2), revision([(1, "x", ["t"]), (2, "y", [])]), revision([(1, "y", ["t"]), (2, "x", None)])}) == 5


HTML = """<body><nav><a href='/a'>A &amp; b</a><a>none</a></nav><h1>Head</h1><p>one<p>two <b>bold</b>
<table><tr><th>h1<th>h2<tr><td>1<td><table><tr><td>in</table></table><ul><li>x<li>y <a href="z">z</a></ul><p> </p></body>"""


def test_table_functions(spark):
    tf.register_table_functions(spark)
    spark.createDataFrame([(1, HTML), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("pages_of_test")
    rows = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert rows("SELECT id, href, text, aside FROM pages_of_test, LATERAL html_links(html) ORDER BY id, node") == [(1, "/a", "A & b", True), (1, "z", "z", False)]
    blocks = rows("SELECT tag, text FROM pages_of_test, LATERAL html_blocks(html) WHERE NOT aside ORDER BY node")
    assert blocks[:3] == [("h1", "Head"), ("p", "one"), ("p", "two bold")] and blocks[-2:] == [("li", "x"), ("li", "y z")]
    cells = rows("SELECT table, row, col, header, text FROM pages_of_test, LATERAL html_table_cells(html) ORDER BY 1, 2, 3")
    assert cells == [(0, 0, 0, True, "h1"), (0, 0, 1, True, "h2"), (0, 1, 0, False, "1"), (0, 1, 1, False, "in"), (1, 0, 0, False, "in")]
    assert rows("SELECT count(*) FROM pages_of_test LEFT JOIN LATERAL html_links(html) l ON true WHERE id > 1") == [(2,)]


def test_containment_of_many_groups(spark):
    """100,000 groups, against a nested loop."""
    n = 100_000
    name = F.concat(F.lit("Unit of "), F.conv((F.col("id") * 7919 % 1_000_003).cast("string"), 10, 36), F.lit(" Étude"))
    groups = spark.range(n).select(name.alias("group"))
    labels = ["unit", "etude", "of", "é", "e", "q", "zz", "1z3", "7k", "of 1a", "nowhere to be found", "", "t of a", "z etu", "k2 e", "unit of 5"]
    got = {r["label"]: r["group"] for r in rs.first_containing(spark.createDataFrame([(x,) for x in labels], "label string"), groups).collect()}
    named = sorted(r["group"] for r in groups.collect())
    folded = [g.lower().replace("é", "e") for g in named]
    want = {x: next((g for g, f in zip(named, folded) if x in f), None) for x in labels if x}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_levels_in_one_shuffle(spark):
    schema = "department string, college string, affiliations array<struct<college:string,department:string>>, good boolean"
    rows = [("a", "X", [("X", "a"), ("X", "b")], True), ("b", "X", None, None), ("", "", [("Y", "c"), ("Y", "c")], True), (None, None, [], False)]
    found = cv.coverage_levels(spark.createDataFrame(rows, schema), {"good": F.col("good")})
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and "Join" not in plan
    got = {(r["level"], r["name"]): (r["members"], r["good"]) for r in found.collect()}
    assert got == {("unit", "a"): (1, 1), ("unit", "b"): (2, 1), ("unit", "c"): (1, 1), ("college", "X"): (2, 1), ("all", ""): (4, 2)}

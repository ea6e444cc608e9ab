"""Record building, resolution, sinks, stream and gate on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from loomframe.operators import coverage as cv
from loomframe.operators import ordered as od
from loomframe.operators import resolve as rs
from loomframe.operators import search as se
from loomframe.plans import crawl as cr
from loomframe.plans import records as rc
from loomframe.sources import sinks as sk
from loomframe.sources import store as st
from loomframe.sources import tables as tb

PEOPLE = (
    "ord long, unit_id string, unit string, college string, page_url string, name string, title string, email string, location string, "
    "roles array<string>, specialty array<string>, profile_url string, "
    "prof struct<name:string,title:string,email:string,google_scholar:string,orcid:string,lab_name:string,lab_url:string,website:string,edis_url:string,"
    "research_summary:string,research_areas:array<string>,teaching:array<string>,extension:array<string>>"
)
UNITS = [(0, "a", "Soil", "College of Earth"), (1, "b", "Water", "College of Earth")]


def person(i, unit, name, url="", email="", title="Professor"):
    ids = {"Soil": "a", "Water": "b"}
    return (i, ids[unit], unit, "College of Earth", f"https://ex.org/{unit}", name, title, email, "", [], [], url, None)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        person(0, "Soil", "Jane Doe", "https://ex.org/p/1", "jdoe@ex.org"), person(1, "Water", "Doe, Jane", "https://ex.org/p/1"),
        person(2, "Water", "Ann Lee", "", "office@ex.org"), person(3, "Soil", "Bob Roe", "", "office@ex.org"),
    ]
    people = spark.createDataFrame(rows, PEOPLE)
    roster = spark.createDataFrame([(0, "Jane Doe", "Dean", "Soil"), (1, "Ian Poe", "Lecturer", "Water"), (2, "Ian Poe", "Lecturer", "Water")], "ord long, name string, title string, department string")
    units = spark.createDataFrame(UNITS, "ord long, id string, name string, college string")
    labels = spark.createDataFrame([("x", "y")], "label string, group string")
    return rc.build_records(people, roster, units, labels).cache()


def test_records(records):
    by = {r["name"]: r for r in records.collect()}
    assert set(by) == {"Jane Doe", "Ann Lee", "Bob Roe", "Ian Poe"}
    assert [a["department"] for a in by["Jane Doe"]["affiliations"]] == ["Soil", "Water"]
    assert by["Jane Doe"]["title"] == "Professor" and by["Ian Poe"]["college"] == "College of Earth"
    assert by["Ann Lee"]["email"] == by["Bob Roe"]["email"] == ""  # shared and like neither name
    assert len({r["id"] for r in by.values()}) == 4


def test_students(spark, records):
    students = spark.createDataFrame([("a", "Soil", "Cid Fox", "PhD", "Doe & Unknown", 0)], "unit_id string, unit string, name string, program string, advisor_raw string, ord long")
    solved = rs.resolve_students(students, records)
    (row,) = solved.collect()
    assert row["advisor_names"] == ["Jane Doe", "Unknown"] and len(row["advisor_ids"]) == 1
    jane = rs.attach_students(records, solved).where("name = 'Jane Doe'").first()
    assert [s["name"] for s in jane["current_students"]] == ["Cid Fox"]


def test_search_and_gate(spark, records):
    found = se.enrich(records)
    assert [r["name"] for r in se.search(found, query="DOE earth").collect()] == ["Jane Doe"]
    assert se.search(found, department="Water").count() == 3
    assert se.kpis(found).first()["departments"] == 2
    header, lines = se.csv_rows(found)
    assert header.startswith('"Name"') and lines.count() == 4
    units = spark.createDataFrame([("https://ex.org", "ok")], "site string, status string")
    gates = cv.quality_gate(records, units, declared=4, least={"records": 4, "units_with_site": 1, "units_ok": 1, "enriched": 0})
    cv.require(gates)
    with pytest.raises(ValueError, match="records"):
        cv.require(cv.quality_gate(records, units))


def test_sinks(spark, records, tmp_path):
    revision = sk.json_document(records.select("id", "name", "affiliations"), {"source": "test"}, str(tmp_path / "doc"))
    assert len(revision) == 10
    back = tb.read_published(spark, str(tmp_path / "doc"))
    assert [r["name"] for r in back.orderBy("ord").collect()] == ["Jane Doe", "Ann Lee", "Ian Poe", "Bob Roe"]
    header, lines = se.csv_rows(records.withColumn("ord", F.col("ord")))
    sk.csv_text(lines, header, str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_bytes().count(b"\r\n") == 5


def greedy(rows):
    clusters = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        for c in clusters:
            if all(not (x[1] and r[1]) or x[1] == r[1] for x in c):
                c.append(r)
                break
        else:
            clusters.append([r])
    return sorted(sorted(r[0] for r in c) for c in clusters)


def test_clusters_are_the_greedy_ones(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", "x@a.b", "y@a.b", "z@a.b"]), rng.randrange(3), f"k{rng.randrange(40)}") for i in range(300)]
    frame = spark.createDataFrame(rows, "ord int, email string, rich int, name string")
    got = {}
    for r in rs.person_clusters(frame, F.col("name"), F.col("email"), [F.desc("rich")], F.col("ord")).collect():
        got.setdefault((r["name"], r["cluster"]), []).append(r["ord"])
    for name in {r[3] for r in rows}:
        assert sorted(sorted(v) for (n, _), v in got.items() if n == name) == greedy([r for r in rows if r[3] == name])


def test_interleave_and_groups(spark):
    frame = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "b")], "i int, h string")
    rows = od.interleave(frame, "h", ["i"], F.col("i")).orderBy("turn", "key_first").collect()
    assert [r["i"] for r in rows] == [0, 2, 1, 4, 3]
    assert {r["h"] for r in od.large_groups(frame, [], "h").collect()} == {"a"}


def test_reachable_pages(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = rc.reachable_pages(links, spark.createDataFrame([("a",)], "url string")).collect()
    assert {(r["url"], r["round"]) for r in got} == {("a", 0), ("b", 1), ("c", 2)}


def test_stream(spark, tmp_path):
    from loomframe.streaming.pages import PAGE_SCHEMA, stream_pages

    pages = spark.createDataFrame([(1, "https://ex.org/", "<body><h1>A</h1><a href='/b'>b</a></body>")], PAGE_SCHEMA)
    pages.write.parquet(str(tmp_path / "in"))
    stream_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/links")).first()["url"] == "https://ex.org/b"


def test_publish(spark, records, tmp_path):
    """What a crawl found, from records to documents, text and snapshot, and the documents read again."""
    out = str(tmp_path / "site")
    assert tb.load_meta(spark, f"{out}/meta") is None
    students = spark.createDataFrame([("a", "Soil", "Cid Fox", "PhD", "Doe & Unknown", 0)], "unit_id string, unit string, name string, program string, advisor_raw string, ord long")
    units = spark.createDataFrame([(0, "College of Earth", "Soil", "https://ex.org", "ok"), (1, "College of Earth", "Water", "", "no_site")], "ord long, college string, department string, site string, status string")
    for whole in (True, False):
        meta = cr.publish_crawl(cr.Crawled(records, rs.resolve_students(students, records), units, units), out, "2026-10-10", {"source": "test"}, whole)
        assert meta == tb.load_meta(spark, f"{out}/meta") and (meta["faculty"], meta["students"], meta["departments"]) == (4, 1, 2)
        if whole:
            assert sorted(r["name"] for r in tb.read_published(spark, f"{out}/faculty").collect()) == ["Ann Lee", "Bob Roe", "Ian Poe", "Jane Doe"]
    assert spark.read.text(f"{out}/faculty").count() == 4
    assert st.read_snapshot(spark, f"{out}/snapshots").count() == 4 and st.load_meta(spark, f"{out}/snapshots")["version"] == 1
    report = spark.read.json(f"{out}/coverage").first()
    assert report["totals"]["faculty"] == 4 and [d["department"] for d in report["departments"]] == ["Soil", "Water"]
    assert spark.read.text(f"{out}/csv").count() == 5

"""Queries over the small made-up pages and records, with the rows that were worked out by hand as their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import text as tx
from loomframe.operators import coverage as cv
from loomframe.operators import extract as ex
from loomframe.operators import resolve as rs
from loomframe.operators import search as se
from loomframe.plans import crawl
import fixtures as fx
from loomframe.plans import records as rc
from loomframe.session import written
from loomframe.sources import html as ht
from loomframe.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _value(v) -> str:
    if isinstance(v, bool) or v is None:
        return str(v).lower() if v is not None else "NULL"
    return f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def worked(columns: str, rows: list[tuple]):
    """Registers ``f(spark)``, whose rows are these; its integers are made long, and its arrays joined by bars."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark)
            kinds = dict(df.dtypes)
            as_told = {"int": lambda c: F.col(c).cast("long"), "array<string>": lambda c: F.array_join(c, "|")}
            return df.select(*[as_told.get(kinds[c], F.col)(c).alias(c) for c in columns.split()])

        QUERIES[f.__name__] = run
        values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {values}) t({', '.join(f'"{c}"' for c in columns.split())})"
        return f

    return add


def _nodes(spark: SparkSession, *names: str) -> tuple[DataFrame, DataFrame]:
    pages = fx.pages(spark, *names)
    return ht.nodes_of(written(ht.parse_pages(pages), "parsed-pages")), pages


@worked("node end parent depth tag lines", [
    (0, 13, -1, 0, "html", "Doctoral students|Student|Advisor|Chair|Topic|Ann Lee|Doe|Roe|Peat"),
    (1, 13, 0, 1, "body", "Doctoral students|Student|Advisor|Chair|Topic|Ann Lee|Doe|Roe|Peat"),
    (2, 2, 1, 2, "h2", "Doctoral students"),
    (3, 13, 1, 2, "table", "Student|Advisor|Chair|Topic|Ann Lee|Doe|Roe|Peat"),
    (4, 8, 3, 3, "tr", "Student|Advisor|Chair|Topic"),
    (5, 5, 4, 4, "th", "Student"),
    (6, 6, 4, 4, "th", "Advisor"),
    (7, 7, 4, 4, "th", "Chair"),
    (8, 8, 4, 4, "th", "Topic"),
    (9, 13, 3, 3, "tr", "Ann Lee|Doe|Roe|Peat"),
    (10, 10, 9, 4, "td", "Ann Lee"),
    (11, 11, 9, 4, "td", "Doe"),
    (12, 12, 9, 4, "td", "Roe"),
    (13, 13, 9, 4, "td", "Peat"),
])
def worked_nodes(spark):
    return _nodes(spark, "students")[0]


@worked("page_id text", [
    ("empty", "Ian Poe\nLecturer in Ecology\nmail"),
    ("table", "Name\nTitle\nE-mail\nArea\nResearch\nDoe, Jane\nProfessor\njane@ex.org\nold\nSoil; Water\nnot a person here 7"),
])
def worked_page_text(spark):
    return ht.page_text(fx.pages(spark, "table", "empty"))


@worked("tok kind level text", [
    (1, "h", 1, "Jane Q. Doe, PhD"),
    (2, "p", 0, "Associate Professor of Soil Science"),
    (3, "h", 6, "Research Interests"),
    (4, "li", 0, "Soil carbon; wetland soils"),
    (5, "li", 0, "Remote sensing"),
    (6, "h", 2, "Teaching"),
    (7, "p", 0, "SWS 4244 Wetlands"),
    (8, "h", 2, "Graduate Students"),
    (9, "li", 0, "Ann Lee (PhD)"),
    (10, "li", 0, "Bob Roe - MS"),
    (11, "p", 0, "Extension focus: nutrient management"),
    (12, "p", 0, "Write to jdoe [at] ex [dot] org"),
])
def worked_tokens(spark):
    return ex.page_tokens(_nodes(spark, "profile")[0])


@worked("sec title level lines", [
    (1, "Jane Q. Doe, PhD", 1, "Associate Professor of Soil Science|Soil carbon; wetland soils|Remote sensing|SWS 4244 Wetlands|Ann Lee (PhD)|Bob Roe - MS|Extension focus: nutrient management|Write to jdoe [at] ex [dot] org"),
    (2, "Research Interests", 6, "Soil carbon; wetland soils|Remote sensing"),
    (3, "Teaching", 2, "SWS 4244 Wetlands"),
    (4, "Graduate Students", 2, "Ann Lee (PhD)|Bob Roe - MS|Extension focus: nutrient management|Write to jdoe [at] ex [dot] org"),
])
def worked_sections(spark):
    return ex.section_lines(ex.page_sections(ex.page_tokens(_nodes(spark, "profile")[0])))


@worked("tok label value", [
    (11, "extension", "nutrient management"),
])
def worked_labels(spark):
    return ex.inline_labels(ex.page_tokens(_nodes(spark, "profile")[0]))


@worked("page_id name title email research_areas teaching extension students google_scholar lab_url lab_name score", [
    ("empty", "Ian Poe", "Lecturer in Ecology", "ipoe@ex.org", "", "", "", "", "", "", "", 2),
    ("profile", "Jane Q. Doe", "Associate Professor of Soil Science", "jdoe@ex.org", "Soil carbon|wetland soils|Remote sensing", "SWS 4244 Wetlands", "nutrient management", "Ann Lee:PhD|Bob Roe:MS", "https://scholar.google.com/citations?user=abc", "https://lab.ex.org/doe", "Doe Lab", 7),
])
def worked_profiles(spark):
    nodes, pages = _nodes(spark, "profile", "empty")
    students = F.transform("profile_students", lambda x: F.concat_ws(":", x["name"], x["program"]))
    return ex.parse_profiles(nodes, pages, fx.DOMAIN).withColumn("students", students)


@worked("name profile_url title email lines", [
    ("Ada Byron", "https://ex.org/people/ada-byron", "Professor of Botany", "ada@ex.org", "Professor of Botany|ada@ex.org"),
    ("Ann Lee", "https://ex.org/news/ann-lee", "", "", ""),
    ("Carl Gauss", "https://ex.org/people/carl-gauss", "Professor of Botany", "carl@ex.org", "Professor of Botany|carl@ex.org"),
    ("Emmy Noether", "https://ex.org/people/emmy-noether", "Professor of Botany", "emmy@ex.org", "Professor of Botany|emmy@ex.org"),
    ("Max Born", "https://ex.org/people/max-born", "Professor of Botany", "max@ex.org", "Professor of Botany|max@ex.org"),
])
def worked_linked_people(spark):
    nodes, pages = _nodes(spark, "linked")
    return ex.linked_people(nodes, pages, fx.DOMAIN)


@worked("page_id method name title email location roles specialty profile_url", [
    ("cards", "cards", "Ada Byron", "Lecturer", "", "Building 0", "", "", ""),
    ("cards", "cards", "Carl Gauss", "Lecturer", "", "Building 1", "", "", ""),
    ("cards", "cards", "Emmy Noether", "Lecturer", "", "Building 2", "", "", ""),
    ("cards", "cards", "Lise Meitner", "Lecturer", "", "Building 4", "", "", ""),
    ("cards", "cards", "Max Born", "Lecturer", "", "Building 3", "", "", ""),
    ("cards", "cards", "Nora Bell", "Lecturer", "", "Building 5", "", "", ""),
    ("linked", "links", "Ada Byron", "Professor of Botany", "ada@ex.org", "", "", "", "https://ex.org/people/ada-byron"),
    ("linked", "links", "Ann Lee", "", "", "", "", "", "https://ex.org/news/ann-lee"),
    ("linked", "links", "Carl Gauss", "Professor of Botany", "carl@ex.org", "", "", "", "https://ex.org/people/carl-gauss"),
    ("linked", "links", "Emmy Noether", "Professor of Botany", "emmy@ex.org", "", "", "", "https://ex.org/people/emmy-noether"),
    ("linked", "links", "Max Born", "Professor of Botany", "max@ex.org", "", "", "", "https://ex.org/people/max-born"),
    ("table", "tables", "Jane Doe", "Professor", "jane@ex.org", "", "", "Soil|Water", ""),
    ("vcards", "vcards", "Ada Byron", "Professor", "", "", "Emeritus", "Soil Physics", "https://ex.org/p/0"),
    ("vcards", "vcards", "Carl Gauss", "Professor", "", "", "Emeritus", "Soil Physics", "https://ex.org/p/1"),
    ("vcards", "vcards", "Emmy Noether", "Professor", "", "", "Emeritus", "Soil Physics", "https://ex.org/p/2"),
    ("vcards", "vcards", "Lise Meitner", "Professor", "", "", "Emeritus", "Soil Physics", "https://ex.org/p/4"),
    ("vcards", "vcards", "Max Born", "Professor", "", "", "Emeritus", "Soil Physics", "https://ex.org/p/3"),
])
def worked_listings(spark):
    """Links, microformat cards, repeated cards and tables, each on a page of its own."""
    nodes, pages = _nodes(spark, "linked", "vcards", "cards", "table")
    return ex.people_on_pages(nodes, pages, fx.DOMAIN)


@worked("kind url", [
    ("faculty", "https://ex.org/faculty/list"),
    ("faculty", "https://ex.org/people/faculty"),
    ("hub", "https://ex.org/people/"),
    ("students", "https://ex.org/grad/students"),
])
def worked_link_kinds(spark):
    nodes, pages = _nodes(spark, "hub")
    return ex.categorize_links(ex.page_links(nodes, pages), fx.DOMAIN)


@worked("url", [
    ("https://ex.org/people?page=2",),
    ("https://ex.org/people?page=3",),
])
def worked_next_pages(spark):
    nodes, pages = _nodes(spark, "people")
    return ex.next_pages(ex.page_links(nodes, pages))


@worked("page_id name program advisor_raw research", [
    ("list", "Ann Lee", "PhD", "Jane Doe", ""),
    ("list", "Bob Roe", "PhD", "Smith", ""),
    ("list", "Cid Fox", "MS", "", ""),
    ("students", "Ann Lee", "PhD", "Doe", "Peat"),
])
def worked_students(spark):
    nodes, _ = _nodes(spark, "students", "list")
    return ex.page_students(nodes, written(ex.page_tokens(nodes), "tokens"))


@worked("college name url", [
    ("College of Soil", "Unit A", "https://ex.org/u/a"),
])
def worked_units(spark):
    nodes, pages = _nodes(spark, "units")
    return ex.catalogue_units(nodes, pages, "^College of")


@worked("page_id site", [
    ("unit", "https://soil.ex.org/"),
])
def worked_unit_site(spark):
    nodes, pages = _nodes(spark, "unit")
    return ex.unit_website(ex.page_links(nodes, pages), fx.DOMAIN, ["cat.ex.org"])


@worked("key name title department", [
    ("doejane", "Jane Doe", "Associate Professor", "Soil Science"),
    ("poeian", "Ian Poe", "Lecturer", "Botany"),
    ("roerick", "Rick Roe", "Professor", ""),
])
def worked_roster(spark):
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(fx.ROSTER_LINES)], "page_id string, pos int, line string")
    return ex.catalogue_roster(lines)


@worked("unit_id ord url", [
    ("a", 0, "https://b.org/"),
    ("a", 1, "https://www.a.org/x"),
    ("a", 2, "https://www.b.org/"),
    ("a", 3, "https://www.a.org/"),
    ("a", 4, "https://a.org/"),
    ("b", 0, "https://c.org/d"),
    ("b", 1, "https://c.org/"),
    ("b", 2, "https://www.c.org/"),
])
def worked_site_candidates(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit_id string")
    fixed = spark.createDataFrame([("a", 1, "https://www.a.org/x"), ("a", 0, "https://b.org/")], "unit_id string, ord int, url string")
    found = spark.createDataFrame([("a", "https://www.a.org/x"), ("b", "https://c.org/d"), ("c", "")], "unit_id string, url string")
    return tb.site_candidates(units, fixed, found)


@worked("unit_id ord url", [
    ("a", 0, "https://a.org/people/"),
    ("a", 1, "https://a.org/faculty/"),
    ("a", 2, "https://a.org/people/faculty/"),
    ("b", 0, "https://b.org/dept/people/"),
    ("b", 1, "https://b.org/dept/faculty/"),
    ("b", 2, "https://b.org/dept/people/faculty/"),
])
def worked_guesses(spark):
    units = spark.createDataFrame([("a", "https://a.org"), ("b", "https://b.org/dept/")], "unit_id string, site string")
    return tb.guessed_pages(units, F.col("site"), tb.PEOPLE_PATHS[:3])


@worked("page_id url", [
    (1, "https://www.ex.org/a#top"),
    (7, "https://ex.org/e?b=1&a=2"),
])
def worked_usable_pages(spark):
    """One page a canonical URL, of the domain, no documents, none that failed."""
    rows = [
        (3, "http://www.ex.org/a?utm_source=x", "p"), (1, "https://www.ex.org/a#top", "q"), (2, "https://www.ex.org/b.pdf", "r"), (4, "https://q.org/", "s"), (5, "https://ex.org/c", None),
        (6, "ftp://ex.org/d", "t"), (7, "https://ex.org/e?b=1&a=2", "u"),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    return tb.distinct_pages(tb.forget_failures(tb.usable_pages(pages, fx.DOMAIN)))


@worked("ord ord_of", [
    (0, 0),
    (1, 0),
    (2, 0),
    (3, 3),
    (4, 3),
    (5, 3),
    (6, 6),
])
def worked_record_groups(spark):
    """In order: by page, else by name and unit; the last one's page leads it to the record that its name did not."""
    rows = [(0, "u", "Jane Doe", "x"), (1, "v", "Doe, Jane", "x"), (2, "v", "Jane Doe", ""), (3, "u", "Ann Lee", ""), (4, "u", "Ann Lee", "y"), (5, "w", "A. Lee", "y"), (6, "w", "Jane Doe", "")]
    return rc.record_groups(spark.createDataFrame(rows, "ord long, unit_id string, name string, profile_url string"))


@worked("name host turn", [
    ("A", "a.org", 1),
    ("B", "a.org", 2),
    ("D", "b.org", 1),
])
def worked_profile_tasks(spark):
    rows = [(0, "u", "A", "https://a.org/1"), (1, "u", "B", "https://a.org/2"), (2, "u", "C", ""), (3, "v", "D", "https://b.org/1"), (4, "u", "E", "https://b.org/2"), (5, "u", "F", "https://a.org/3")]
    return rc.profile_tasks(spark.createDataFrame(rows, "ord long, unit_id string, name string, profile_url string"), per_unit=3)


@worked("url round", [
    ("a", 0),
    ("b", 1),
    ("c", 2),
])
def worked_reachable(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    return rc.reachable_pages(links, spark.createDataFrame([("a",)], "url string"), 2)


@worked("name title department college cat_dept affs", [
    ("Jane Doe", "Dean", "Soil", "", "Dept. of Soil", ""),
    ("Ray Moon", "", "", "", "", ""),
    ("Ray Moon", "Lecturer", "Air", "", "", ""),
    ("Una Note", "Chair", "Sky", "College of Sky", "Sky", "College of Sky/Sky"),
])
def worked_roster_fill(spark):
    """Rows of the roster that meet records, that make them, and that meet those made."""
    aff = "array<struct<college:string,department:string,shared:boolean>>"
    records = spark.createDataFrame([(0, "Jane Doe", "Soil", "", "", "", [])], f"ord long, name string, department string, college string, title string, cat_dept string, affiliations {aff}")
    rows = [(0, "Doe, Jane", "Dean", "Dept. of Soil"), (1, "Ray Moon", "", ""), (2, "Ray Moon", "Lecturer", "Air"), (3, "Una Note", "", "Sky"), (4, "Una Note", "Chair", ""), (5, "Una Note", "Dean", "Sky")]
    roster = spark.createDataFrame(rows, "ord long, name string, title string, department string")
    colleges = spark.createDataFrame([("sky", "College of Sky")], "unit_key string, college string")
    affs = F.array_join(F.transform("affiliations", lambda a: F.concat_ws("/", a["college"], a["department"])), "|")
    return rs.fill_from_roster(records, roster, colleges).withColumn("affs", affs)


@worked("name topics initials rich", [
    ("Ann Mary Lee", 17, "AM", 1),
    ("Bob Roe", 98, "BR", 1),
    ("Cy Fox", 260, "CF", 1),
    ("Di Ash", 0, "DA", 1),
    ("Ed Elm", 136, "EE", 1),
])
def worked_topics(spark):
    empty, none = F.lit(""), F.array().cast("array<string>")
    rows = [("Ann Mary Lee", "Remote sensing of soils"), ("Bob Roe", "Deep learning; climate models, wetlands"), ("Cy Fox", "Statistics and GIS"), ("Di Ash", "Law"), ("Ed Elm", "precision farming, ecology")]
    base = spark.createDataFrame(rows, "name string, area string").select(
        "name", F.array("area").alias("research_areas"), *[empty.alias(c) for c in ("title", "college", "department", "lab_name", "research_summary", "email", "google_scholar")],
        *[none.alias(c) for c in ("teaching", "extension", "roles")], F.array().cast("array<struct<name:string,program:string>>").alias("current_students"),
        F.array().cast("array<struct<college:string,department:string>>").alias("affiliations"),
    )
    return se.enrich(base)


@worked("what value", [
    ("date", "Oct 10, 2026, 3:04 PM"),
    ("many", "1,234,567"),
    ("never", "Never"),
    ("none", "0"),
])
def worked_formats(spark):
    row = spark.range(1).select(
        tx.count_text(F.lit(1234567)).alias("many"), tx.count_text(F.lit(None).cast("long")).alias("none"), tx.date_text(F.lit("2026-10-10T15:04:00+00:00")).alias("date"), tx.date_text(F.lit("")).alias("never")
    )
    return row.unpivot([], ["many", "none", "date", "never"], "what", "value")


@worked("name title college department email areas teaching affs students sources", [
    ("Eva Kern", "Professor", "College of Earth", "Soil", "", "", "", "College of Earth/Soil", "Bob Roe:PhD", "https://soil.ex.org/people/eva-kern|https://soil.ex.org/faculty/"),
    ("Ian Poe", "Lecturer", "College of Earth", "Soil", "", "", "SWS 4244 Wetlands", "College of Earth/Soil", "", "https://soil.ex.org/people/ian-poe|https://soil.ex.org/faculty/"),
    ("Jane Doe", "Professor", "College of Earth", "Soil", "jdoe@ex.org", "Peat|Soil carbon", "", "College of Earth/Soil", "Ann Lee:PhD|Kim Ash:MS", "https://soil.ex.org/people/jane-doe|https://soil.ex.org/faculty/|https://cat.ex.org/roster"),
    ("Jane Doe", "Professor", "College of Earth", "Water", "jane@ex.org", "", "", "College of Earth/Water", "", "https://water.ex.org/people/"),
    ("Ray Moon", "Professor", "College of Sky", "Stars", "", "", "", "College of Sky/Stars", "", "https://cat.ex.org/roster"),
    ("Una Note", "Lecturer", "College of Medicine", "", "", "", "", "College of Medicine/", "", "https://cat.ex.org/roster"),
])
def crawl_records(spark):
    """From pages of a made-up site to its records: two listing pages, profiles, a table, students and a roster."""
    found = crawl.crawl_pages(*fx.site(spark), fx.DOMAIN, roster_url="https://cat.ex.org/roster").records
    affs = F.array_join(F.transform("affiliations", lambda a: F.concat_ws("/", a["college"], a["department"])), "|")
    students = F.transform("current_students", lambda x: F.concat_ws(":", x["name"], x["program"]))
    return found.withColumns({"affs": affs, "students": students, "areas": F.col("research_areas")})


@worked("document", [(
    '{"updated_at":"t","status_counts":{"no_site":1,"ok":1},"colleges":[{"name":"Earth","departments":1,"faculty":1,"departments_ok":1},'
    '{"name":"Sky","departments":1,"faculty":1,"departments_ok":0}],"departments":[{"department":"Soil","faculty_in_database":2,"college":"Earth","site":"s","status":"ok",'
    '"with_email":1,"with_scholar":0,"with_research":1,"with_teaching":0},{"department":"Air","faculty_in_database":0,"college":"Sky","site":"","status":"no_site",'
    '"with_email":0,"with_scholar":0,"with_research":0,"with_teaching":0}],"totals":{"faculty":2,"students":3,"with_email":1,"with_scholar":0,"with_research":1,'
    '"with_teaching":0,"with_students":1,"with_college":2},"errors":[{"url":"u","error":"404"}]}',
)])
def coverage_json(spark):
    """The coverage report as one nested document."""
    units = spark.createDataFrame([(0, "Earth", "Soil", "s", "ok"), (1, "Sky", "Air", "", "no_site")], "ord long, college string, department string, site string, status string")
    kinds = (
        "department string, college string, affiliations array<struct<department:string>>, email string, google_scholar string, research_areas array<string>, teaching array<string>, "
        "current_students array<string>"
    )
    records = spark.createDataFrame([("Soil", "Earth", [], "a@b.c", "", ["x"], [], ["y"]), ("", "Sky", [("Soil",), ("Soil",)], "", "", [], [], [])], kinds)
    errors = spark.createDataFrame([("u", "404")], "url string, error string")
    report = cv.coverage_document(units, records, spark.range(3), {"updated_at": "t"}, errors)
    return report.select(F.to_json(F.struct(*report.columns)).alias("document"))

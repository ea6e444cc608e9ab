"""Work that grows with the input only: rows that joins make, elements that lambdas compare, plans that drivers hold."""

import cProfile
import pstats
import time
import tracemalloc

from pyspark.sql import functions as F

from loomframe.functions import emails as em
from loomframe.functions import text as tx
from loomframe.operators import clean as cl
from loomframe.operators import extract as ex
from loomframe.operators import resolve as rs
from loomframe.session import written
from loomframe.sources import html as ht


def most_rows(frame) -> int:
    """The most rows that any step of the frame's plan made."""
    frame.collect()

    def walk(node) -> int:
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        made = node.metrics().get("numOutputRows")
        below = node.children()
        return max([made.get().value() if made.isDefined() else 0] + [walk(below.apply(i)) for i in range(below.size())])

    return walk(frame._jdf.queryExecution().executedPlan())


def test_resolve_unique_makes_no_pairs(spark):
    wanted = spark.range(600).select("id", F.lit("x").alias("unit"), F.when(F.col("id") % 2 == 0, "").otherwise("b").alias("initial"))
    known = spark.range(500).select(F.lit("x").alias("unit"), F.when(F.col("id") == 7, "b").otherwise("a").alias("initial"), F.col("id").alias("target"))
    found = rs.resolve_unique(wanted, known, ["unit"])
    assert most_rows(found) <= 600
    rows = {r["id"]: (r["target"], r["candidates"]) for r in found.collect()}
    assert rows == {i: (None if i % 2 == 0 else 7, 500) for i in range(600)}


def test_resolve_unique_counts_over_all_rows_of_an_id(spark):
    wanted = spark.createDataFrame([(1, "x", "b"), (1, "y", "b"), (2, "y", None), (3, "z", "b"), (4, None, "b")], "id long, unit string, initial string")
    known = spark.createDataFrame([("x", "a", 5), ("y", "b", 6), ("y", None, None), (None, "b", 8)], "unit string, initial string, target long")
    rows = {r["id"]: (r["target"], r["candidates"]) for r in rs.resolve_unique(wanted, known, ["unit"]).collect()}
    assert rows == {1: (6, 2), 2: (6, 1), 3: (None, 0), 4: (None, 0)}


def test_combine_clusters_of_many_copies(spark):
    """3,000 rows of one person: each element's key is worked out once, not once for each other element."""
    none = F.array().cast("array<string>")
    unit = F.concat(F.lit("Department of Plot "), (F.col("id") % 700).cast("string"))
    aff = F.array(F.struct(F.lit("Earth").alias("college"), unit.alias("department"), F.lit(False).alias("shared")))
    student = F.array(F.struct(F.concat(F.lit("Ann "), (F.col("id") % 900).cast("string")).alias("name"), F.lit("PhD").alias("program")))
    rows = spark.range(0, 3000, 1, 1).select(
        F.col("id").alias("ord"), F.lit("Jane Doe").alias("name"), F.lit("").alias("email"), F.lit("").alias("profile_url"), F.lit("Earth").alias("college"), unit.alias("department"),
        none.alias("research_areas"), none.alias("teaching"), aff.alias("affiliations"), student.alias("current_students"),
    )
    start = time.monotonic()
    [r] = rs.merge_duplicates(rows).collect()
    assert time.monotonic() - start < 40  # 9 million keys took minutes
    assert [a["department"] for a in r["affiliations"]] == [f"Department of Plot {i}" for i in range(700)]
    assert [s["name"] for s in r["current_students"]] == [f"Ann {i}" for i in range(900)]


def plan_size(frame) -> int:
    return len(frame._jdf.queryExecution().optimizedPlan().toString())


def test_fold_is_small_in_plans(spark):
    folded = spark.createDataFrame([("ﬁ 각 é",)], "x string").select(tx.fold(F.col("x")).alias("x"))
    assert plan_size(folded) < 35_000  # its tables once, not three times
    assert folded.first()["x"] == "fi 각 e"


def test_profiles_leave_a_small_plan(spark):
    pages = spark.createDataFrame([(1, "https://u.ex.org/p/1", "<html><body><main><h1>Jane Doe</h1><p>Professor of Soils</p><p>jdoe@ex.org</p></main></body></html>")], "page_id long, url string, html string")
    found = ex.parse_profiles(ht.nodes_of(written(ht.parse_pages(pages), "test-parsed")), pages, "ex.org")
    assert plan_size(found) < 50_000  # 750,000 in one plan before: a driver keeps each plan as text
    [r] = found.collect()
    assert (r["name"], r["title"], r["email"]) == ("Jane Doe", "Professor of Soils", "jdoe@ex.org")


def test_pages_are_dealt_before_they_are_read(spark):
    """A file packs many pages into one split; reading them was one task, however many there were."""
    pages = spark.range(0, 300, 1, 1).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 6000), F.lit("</p>")).alias("html"))
    parsed = ht.parse_pages(pages)
    assert parsed.rdd.getNumPartitions() == 5  # nine million bytes
    assert sorted((r["page_id"], r["n"]) for r in parsed.select("page_id", F.size("elements").alias("n")).collect()) == [(i, 1) for i in range(300)]


def test_tokens_read_pages_once(spark):
    html = "<body><main><h1>Jane</h1><p><b>Focus:</b></p><p>Soils <b>x</b></p><table><tr><td>a</td><td></td><td>b</td></tr></table></main></body>"
    tokens = ex.page_tokens(ht.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1  # four times before
    got = [(r["tok"], r["kind"], r["level"], r["text"], r["cells"]) for r in tokens.orderBy("tok").collect()]
    assert got == [(1, "h", 1, "Jane", None), (2, "h", 6, "Focus", None), (3, "p", 0, "Soils x", None), (4, "row", 0, "a | b", ["a", "", "b"])]


def test_cells_move_their_text_once(spark):
    html = (
        "<table><tr><th>Name</th><th>Title</th><th>E-mail</th><th>Research</th></tr><tr><td>Doe, Jane</td><td>Professor</td><td><nav>x@ex.org</nav>jdoe@ex.org</td><td><p>peat</p><p>soil water</p></td></tr>"
        "<tr><td>Roe, Ann</td><td>Lecturer</td><td>aroe@ex.org</td><td>lakes</td></tr></table>"
    )
    nodes = ht.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    cells = {r["text"]: (r["listed"], r["loud"]) for r in ex.table_cells(nodes).collect()}
    assert cells["lakes"] == (None, None) and cells["peat soil water"] == ("peat; soil water", None) and cells["x@ex.org jdoe@ex.org"][1] == "jdoe@ex.org"
    people = {r["name"]: (r["email"], r["specialty"]) for r in ex.table_people(nodes).collect()}
    assert people == {"Jane Doe": ("jdoe@ex.org", ["peat", "soil water"]), "Ann Roe": ("aroe@ex.org", ["lakes"])}


def test_sections_read_pages_once(spark):
    html = "<body><main><h1>Jane</h1><p>a</p><h2>Focus</h2><p>b</p></main></body>"
    found = ex.section_lines(ex.page_sections(ex.page_tokens(ht.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapIn") == 1  # four times before
    assert sorted((r["title"], r["level"], r["lines"]) for r in found.where("title <> ''").collect()) == [("Focus", 2, ["b"]), ("Jane", 1, ["a", "b"])]


def test_pages_of_null_and_no_html_give_no_elements(spark):
    """Whole columns of nulls, and pages of several element kinds, through Arrow arrays of a frame."""
    pages = spark.createDataFrame([(None, "<a href='/x' title>t</a>"), (2, None), (3, ""), (4, "plain")], "page_id long, html string")
    [r] = ht.parse_pages(pages).collect()
    assert r["page_id"] is None and r["elements"][0]["attrs"] == {"href": "/x", "title": ""} and r["pieces"][0]["text"] == "t"
    assert ht.parse_pages(pages.where("page_id > 1")).count() == 0


def test_students_leave_a_small_plan(spark):
    html = "<html><body><h2>Doctoral students</h2><table><tr><th>Student</th><th>Advisor</th></tr><tr><td>Ann Lee</td><td>Jane Doe</td></tr></table></body></html>"
    pages = spark.createDataFrame([(1, "https://u.ex.org/s", html), (2, "https://u.ex.org/t", "<html><body><h2>PhD students</h2><ul><li>Bo Roe (PhD)</li></ul></body></html>")], "page_id long, url string, html string")
    nodes = ht.nodes_of(written(ht.parse_pages(pages), "test-parsed"))
    found = ex.page_students(nodes, ex.page_tokens(nodes))
    assert plan_size(found) < 30_000
    assert sorted((r["page_id"], r["name"], r["program"], r["advisor_raw"]) for r in found.collect()) == [(1, "Ann Lee", "PhD", "Jane Doe"), (2, "Bo Roe", "PhD", "")]


def test_clean_up_leaves_small_plans(spark):
    """Tables of folding and of names of characters are in a plan wherever a text is folded or unescaped."""
    kind = "ord long, name string, affiliations array<struct<college:string,department:string,shared:boolean>>, department string"
    affs = [("", "Dept & Co", True), ("Earth", "The Department of Dept and Co", False), ("Earth", "Dept  and Co", None), ("", "Peat Department", False), (None, "Soils", False)]
    records = spark.createDataFrame([(1, "Ann Lee", affs, "peat"), (2, "Bo Roe", [], ""), (3, "Cy Doe", [], "SOILS")], kind)
    units = spark.createDataFrame([(5, "Soils", "Earth"), (4, "Department of Soils &amp; Water", "Earth")], "ord long, name string, college string")
    found = cl.canonicalize(records, units)
    assert plan_size(found) < 100_000  # 1,436,969 in a whole crawl before
    rows = {r["name"]: (r["department"], [tuple(a) for a in r["affiliations"] or []]) for r in found.collect()}
    assert rows["Ann Lee"] == ("peat", [("Earth", "Dept and Co", True), ("", "peat", False), ("", "Soils", False)])
    assert rows["Bo Roe"] == ("", []) and rows["Cy Doe"][0] == "Soils"


def test_addresses_leave_small_plans(spark):
    frame = spark.createDataFrame([(["x@q.org", "jdoe@ex.org"], "Doe, Jane")], "emails array<string>, name string")
    picked = frame.select(em.pick_email(F.col("emails"), F.col("name"), "ex.org").alias("p"), em.email_matches(F.get("emails", F.lit(1)), F.col("name")).alias("m"))
    assert plan_size(picked) < 120_000  # 169,000 before
    assert tuple(picked.first()) == ("jdoe@ex.org", True)


def test_cards_join_their_texts_last(spark, monkeypatch):
    """Of all like children only the first lines move; the texts join the cards of the parent that was chosen."""
    seen = {}
    monkeypatch.setattr(ex, "written", lambda df, label: (seen.update({label: df.columns}), written(df, label))[1])
    item = '<li><a href="/p/{0}">Jane {1}</a><p>Professor of Soils</p><p>j{0}@ex.org</p></li>'
    html = "<body><ul>" + "".join(item.format(i, n) for i, n in enumerate(["Doe", "Roe", "Lee", "Poe", "Zoe"])) + "</ul><div>" + "<p>word</p>" * 9 + "</div></body>"
    pages = spark.createDataFrame([(1, "https://u.ex.org/list", html)], "page_id long, url string, html string")
    rows = sorted((r["name"], r["title"], r["email"], r["profile_url"]) for r in ex.card_people(ht.page_nodes(pages), pages, "ex.org").collect())
    assert rows == sorted((f"Jane {n}", "Professor of Soils", f"j{i}@ex.org", f"https://u.ex.org/p/{i}") for i, n in enumerate(["Doe", "Roe", "Lee", "Poe", "Zoe"]))
    assert "lines" not in seen["cards"] + seen["named-cards"]  # all of them moved twice before


def test_listings_leave_small_plans(spark, monkeypatch):
    """Links of both modes are worked out at once, and a plan holds the tables of folding once: it held them up to six times, twice as often with its changes."""
    seen = []
    monkeypatch.setattr(ex, "written", lambda df, label: (seen.append((label, plan_size(df))), written(df, label))[1])
    card = '<div><h3><a href="/people/p{0}">{1}</a></h3><p>{1}, PhD</p><p>Professor of Soils</p><p>p{0}@ex.org</p></div>'
    html = "<html><body><main>" + "".join(card.format(i, n) for i, n in enumerate(["Jane Doe", "Ann Roe", "Bo Lee", "Éva Poe", "Ida Zoe", "ÉVA POE"])) + "</main></body></html>"
    pages = spark.createDataFrame([(1, "https://u.ex.org/list", html)], "page_id long, url string, html string")
    nodes = ht.nodes_of(written(ht.parse_pages(pages), "test-parsed"))
    rows = ex.listing_people(nodes, pages, "ex.org").collect()
    assert sorted((r["name"], r["title"], r["email"], r["profile_url"][-2:], list(r["lines"])) for r in rows) == sorted(
        (n, "Professor of Soils", f"p{i}@ex.org", f"p{i}", ["Professor of Soils", f"p{i}@ex.org"]) for i, n in enumerate(["Jane Doe", "Ann Roe", "Bo Lee", "Éva Poe", "Ida Zoe"])
    )
    assert [label for label, _ in seen].count("candidates") == 1 and [label for label, _ in seen].count("method-cards") == 3  # 2 and 4 before
    assert max(size for label, size in seen if label != "listed") < 60_000  # listed: its fields are read in a step without a shuffle


CARDS = "<body>" + "<div class='c'><p>Jane <b>Doe</b></p><ul><li><a href='/p'>x</a></li></ul></div>" * 2000 + "</body>"


def test_reading_is_a_few_calls_an_element():
    profile = cProfile.Profile()
    profile.enable()
    page = ht.read_page(CARDS)
    profile.disable()
    assert len(page.rows) == 12_001
    assert pstats.Stats(profile).total_calls < 60 * 12_001  # 80 calls an element before


def test_reading_holds_little_an_element():
    ht._arrow_pages([ht.read_page("<p>x</p>")])  # imports
    tracemalloc.start()
    page = ht.read_page(CARDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(page.pieces) == 6_000
    assert peak < 1_100 * 12_001  # 1,363 bytes an element before


def test_plain_tags_are_read_as_others():
    """Tags without attributes take a short way; their case, raw text, lists, roles and text around them come out alike."""
    plain = "<HTML><Body><nav><ul><li>a<li>b</UL></nav><script>var t = '</p><p>';</script><title>x &lt;b></title><p>c\xa0 d<p>e<textarea>f</textarea></p ><br>g</body></html>"
    marked = plain.replace("<li>", "<li x>").replace("<p>", "<p x>").replace("<ul>", "<ul x>").replace("<nav>", "<nav x>").replace("<Body>", "<Body x>").replace("'</p><p x>'", "'</p><p>'")
    rows, others = ht.read_page(plain), ht.read_page(marked)
    assert rows.pieces == others.pieces == [("a", True, 4), ("b", True, 5), ("x <b>", False, -1), ("c d", False, -1), ("e", False, -1), ("f", False, -1), ("g", False, -1)]
    assert [r | {"attrs": {}} for r in rows.rows] == [r | {"attrs": {}} for r in others.rows]
    told = [(r["tag"], r["parent"], r["depth"], r["end"], r["aside"], r["above"], list(r["children"]), list(r["inner"])) for r in rows.rows]
    assert told[:5] == [
        ("html", -1, 0, 11, False, [], ["body"], ["body", "br", "li", "nav", "p", "script", "textarea", "title", "ul"]),
        ("body", 0, 1, 11, False, [], ["br", "nav", "p", "script", "title"], ["br", "li", "nav", "p", "script", "textarea", "title", "ul"]),
        ("nav", 1, 2, 5, False, [], ["ul"], ["li", "ul"]), ("ul", 2, 3, 5, True, [2], ["li"], ["li"]), ("li", 3, 4, 4, True, [3, 2], [], []),
    ]


def test_long_pages_are_read_in_parts(spark):
    """Each element's row held the text of its whole page until it was cut: 4,000 elements of a 0.7 MB page filled a heap of 2 GB."""
    item = "<p><a href='/{0}'>{0}</a> " + "word " * 30 + "</p>"
    html = "<html><body><article><h1>Jane</h1>" + "".join(item.format(i) for i in range(1500)) + "</article></body></html>"
    pages = spark.createDataFrame([(1, "https://u.ex.org/", html)], "page_id long, url string, html string")
    parsed = written(ht.parse_pages(pages), "test-parsed")
    sizes = parsed.agg(F.sum(F.size("elements")), F.sum(F.size("elements") * F.size("pieces")), F.sum(F.size("pieces"))).first()
    assert sizes[0] == 3_004 and sizes[1] < 200 * 3_004 and sizes[2] < 3 * 3_001  # 3,001 pieces beside each element before
    nodes = ht.nodes_of(parsed)
    links = ex.page_links(nodes, pages).orderBy("node").collect()
    assert [(r["url"], r["text"]) for r in links] == [(f"https://u.ex.org/{i}", str(i)) for i in range(1500)]
    tokens = ex.page_tokens(nodes).orderBy("tok").collect()
    assert tokens[0]["text"] == "Jane" and [r["text"] for r in tokens[1:]] == [f"{i} " + " ".join(["word"] * 30) for i in range(1500)]
    assert nodes.where("tag = 'article'").first()["lines"] == ["Jane"] + [x for i in range(1500) for x in (str(i), " ".join(["word"] * 30))]
    [whole] = ht.page_text(pages).collect()
    assert whole["text"].count("\n") == 3_000


def test_parts_of_deep_and_empty_elements_are_few():
    for html, n in (("<b>x" * 5000, 5000), ("<p>" + "word " * 999 + "<br>" * 20_000, 20_001), ("<ul>" + "<li>a<p>b</p><br>" * 3000, 9_001)):
        page = ht.read_page(html)
        want = [(r["node"], page.pieces[r["low"] : r["high"]]) for r in page.rows]
        parts = list(ht._parts(page))
        got = sorted((r["node"], p.pieces[r["low"] : r["high"]]) for p in parts for r in p.rows)
        assert len(got) == n and got == want
        assert sum(len(p.pieces) for p in parts) < 4 * n


def test_profiles_of_long_pages_are_read_in_frames(spark):
    """A page's elements were one row of one frame, however many; parts keep frames small, and a profile is put together over all of them."""
    html = "<html><body><main><h1>Jane Doe</h1><p>Professor of Soils</p><ul>" + "<li>a <b>b</b></li>" * 4000 + "</ul><p>jdoe@ex.org</p><h2>Research</h2><ul><li>peat; soil water</li></ul></main></body></html>"
    pages = spark.createDataFrame([(1, "https://u.ex.org/p/1", html)], "page_id long, url string, html string")
    parsed = written(ht.parse_pages(pages), "test-parsed")
    most, n = parsed.agg(F.max(F.size("elements")), F.sum(F.size("elements"))).first()
    assert n == 8_010 and most <= 256  # 8,010 in a row before
    [r] = ex.parse_profiles(ht.nodes_of(parsed), pages, "ex.org").collect()
    assert (r["name"], r["title"], r["email"], r["research_areas"]) == ("Jane Doe", "Professor of Soils", "jdoe@ex.org", ["peat", "soil water"])


def test_only_poor_profiles_are_read_loosely(spark, monkeypatch):
    """All pages were read loosely too, for nothing where the strict reading is good; here two of five need it."""
    read = {}
    monkeypatch.setattr(ex, "written", lambda df, label: (read.setdefault(label, []).append(df := written(df, label)), df)[1])
    good = "<main><h1>{0}</h1><p>Professor of Soils</p><p>x{1}@ex.org</p><h2>Research Interests</h2><ul><li>peat; soil water</li></ul></main>"
    poor = "<main><h1>{0}</h1></main><div><p>Professor of Soils</p><p>x{1}@ex.org</p><h2>Research Interests</h2><ul><li>peat; soil water</li></ul></div>"
    people = [("Ann Lee", good), ("Bo Roe", poor), ("Ida Poe", good), ("Jane Doe", good), ("No Name 7", poor)]
    html = [(i, f"https://u.ex.org/p/{i}", "<html><body>" + form.format(n, i) + "</body></html>") for i, (n, form) in enumerate(people)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    rows = ex.parse_profiles(ht.nodes_of(written(ht.parse_pages(pages), "test-parsed")), pages, "ex.org").orderBy("page_id").collect()
    assert [(r["page_id"], r["name"], r["title"], list(r["research_areas"]), r["score"] >= 3) for r in rows] == [(i, people[i][0], "Professor of Soils", ["peat", "soil water"], True) for i in range(4)]
    strict, loose = (sorted(r["page_id"] for r in t.select("page_id").distinct().collect()) for t in read["profile-tokens"])
    assert strict == [0, 1, 2, 3, 4] and loose == [1, 4]  # all five before

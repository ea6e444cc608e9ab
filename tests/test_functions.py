"""Scalar functions on rows with hand-derived values."""

import pytest
from pyspark.sql import functions as F

from loomframe.functions import emails as em
from loomframe.functions import text as tx
from loomframe.functions import urls as ur
from loomframe.operators import clean as cl
from loomframe.operators import search as se


def values(spark, f, rows):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in frame.select(f(F.col("x")).alias("v"), "i").orderBy("i").select("v").collect()]


@pytest.mark.parametrize(("f", "rows"), [
    (tx.fold, {"Péñà ø ß": "pena ø ß", "": "", None: ""}),
    (tx.squash, {"a  b\n": "a b", None: ""}),
    (tx.display_name, {"Doe, Jane Q., PhD": "Jane Q. Doe", "Dr. Ann (Annie) Lee": "Ann Lee"}),
    (tx.last_name, {"Jane de la Doe": "de la doe", "Van Tran": "van tran", "": ""}),
    (tx.name_key, {"Van Tran": "van van tran", "José  M. Pérez": "jose perez"}),
    (tx.initials, {"Ann Mary Lee": "AM", "": ""}),
    (tx.looks_like_name, {"Jane Doe": True, "Read More": False, "P., A.": False, "Jane": False, "Room 7 B": False, "Juan de la Cruz": True, None: False}),
    (tx.split_advisors, {"Ash & Birch (Temp), Cedar": ["Ash", "Birch", "Cedar"], "": []}),
    (tx.slug_to_phrase, {"soil-and_water": "Soil and Water", "of-mice": "Of Mice"}),
    (tx.strip_dept, {"Department of Soil &amp; Water": "Soil and Water", "Botany Department": "Botany"}),
    (tx.dept_key, {"Soil, Water & Air": "soil water and air"}),
    (tx.norm_unit, {"School of Soil & Water": "soil and water"}),
    (tx.program, {"Doctoral": "PhD", "M.S.": "MS", "postdoc": "Postdoc", "postdoctoral": "PhD", "biology": "Undergraduate", "x": ""}),
    (ur.canon_url, {"HTTP://Ex.org:80?b=2&utm_source=x&a=1#f": "https://ex.org/?a=1&b=2", "mailto:a@b.org": "", None: "", "ftp://a.b/": "", "https://a.b:8080/x?k=&m=1&m=2": "https://a.b:8080/x?m=1"}),
    (ur.canon_scholar, {"https://scholar.google.com/citations?hl=en&user=ab": "https://scholar.google.com/citations?user=ab"}),
    (em.find_emails, {"x A.b@Ex.org, c [at] ex [dot] org": ["a.b@ex.org", "c@ex.org"], None: []}),
    (cl.clean_title, {"Affiliations Professor | ": "Professor", "Dean's Office": "", "x" * 141: ""}),
    (cl.is_staff, {"Office Manager": True, "Professor and Office Manager": False, "": False}),
    (cl.is_noise_text, {"Read more": True, "PhD, MS": True, "Soil carbon": False, "": True}),
    (cl.student_name_ok, {"Ann Lee": True, "Thesis Forms": False, "Dr. Ann Lee": False, "Rinker Hall": False}),
])
def test_scalars(spark, f, rows):
    assert values(spark, f, list(rows)) == list(rows.values())


def test_relative_urls(spark):
    base = F.lit("https://ex.org/a/b/c")
    got = values(spark, lambda c: ur.canon_url(c, base), ["/x", "../z", "?page=2", "d", "//q.org/y", "#top", "./e"])
    assert got == ["https://ex.org/x", "https://ex.org/a/z", "https://ex.org/a/b/c?page=2", "https://ex.org/a/b/d", "https://q.org/y", "", "https://ex.org/a/b/e"]


def test_picks_the_person_over_the_office(spark):
    frame = spark.createDataFrame([(["info@ex.org", "zed@ex.org", "jdoe@ex.org"], "Jane Doe"), (["info@ex.org"], "Jane Doe"), ([], "")], "e array<string>, n string")
    got = [r[0] for r in frame.select(em.pick_email(F.col("e"), F.col("n"), "ex.org")).collect()]
    assert got == ["jdoe@ex.org", "", ""]


def test_query_and_csv(spark):
    frame = spark.createDataFrame([("soil • water", 'a"b', None)], "blob string, x string, y string")
    row = frame.select(se.matches_query(F.col("blob"), "WATER so"), se.matches_query(F.col("blob"), "air"), tx.to_csv_line(F.col("x"), F.col("y"))).first()
    assert tuple(row) == (True, False, '"a""b",""')


def test_area_rules(spark):
    areas = ["Soil carbon", "soil CARBON", "Department of Botany", "Botany", "CLIN AST PROF", "Associate Professor", "call 352-392-1234", "Ann Lee", "Wetlands;"]
    frame = spark.createDataFrame([(areas, "Ann Lee")], "a array<string>, n string")
    got = frame.select(cl.clean_areas(F.col("a"), F.col("n"), F.lit(["botany"]), F.lit(["chemistry"]))).first()[0]
    assert got == ["Soil carbon", "Wetlands"]


def test_fold_grows_in_line_with_the_text(spark):
    """All kinds of characters against unicodedata; arrays at once give what single elements give, whatever they hold."""
    import random
    import unicodedata

    def plain(t):
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()

    dice = random.Random(2)
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x1E00, 0x2200), *range(0xAC00, 0xAC40), *range(0xFB00, 0xFB10), 0x1F600, 0xFFFF, 1, 2)]
    rows = ["", "½", "a½b½é", "한글 test", "Σίσυφος ΣΑΣ", "ﬁne ŒUVRE Ĳ ŉ", *("".join(dice.choices(pool, k=dice.randint(1, 40))) for _ in range(200)), "".join(dice.choices(pool, k=3000))]
    assert values(spark, tx.fold, rows) == [plain(r) for r in rows]
    arrays = [[], ["É", "é", "E", None, "x"], ["½", "1⁄2", ""], ["a\u0001b", "A\u0001B", "\u0002", "\u0002a"], rows[:80]]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, x array<string>")
    for r in frame.select("i", tx.fold_each(F.col("x")).alias("f"), tx.fold_distinct(F.col("x")).alias("d")).collect():
        keys = [plain(x or "") for x in arrays[r["i"]]]
        assert r["f"] == keys
        assert r["d"] == [x for j, x in enumerate(arrays[r["i"]]) if keys[j] not in keys[:j]]

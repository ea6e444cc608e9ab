"""Faceted search over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.text import initials, present, to_csv_line

PAGE = 48
# Topics and what names them in a lower-cased record.
TOPICS = {
    "Remote sensing": r"remote sensing|satellite|lidar|hyperspectral|earth observation|radiometr|sar\b",
    "Machine learning / AI": r"machine learning|artificial intelligence|deep learning|neural network|\bai\b|data[- ]driven",
    "GIS & geospatial": r"\bgis\b|geospatial|geographic information|spatial analysis|mapping",
    "Precision agriculture": r"precision (agri|farming)|crop model|smart farming|sensors? for agri",
    "Soil science": r"\bsoils?\b|pedolog|soil physics|soil moisture|vadose",
    "Hydrology & water": r"hydrolog|watershed|groundwater|water (quality|resources|management)|irrigation|wetland",
    "Climate": r"climate|meteorolog|atmospher|carbon cycl|global change",
    "Ecology & environment": r"ecolog|conservation|biodiversity|environmental",
    "Data science": r"data science|statistic|bioinformatic|computational|modeling|modelling",
}


def search_blob(parts: list[Column]) -> Column:
    """All non-empty parts, arrays element by element, joined and lower-cased."""
    return F.lower(F.concat_ws(" • ", *parts))


def topic_mask(blob: Column, patterns: list[str]) -> Column:
    """Bit i is set if pattern i occurs."""
    return reduce(Column.__add__, [F.when(F.regexp_like(blob, F.lit(p)), 1 << i).otherwise(0) for i, p in enumerate(patterns)])


def richness(flags: list[Column]) -> Column:
    return reduce(Column.__add__, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def matches_query(blob: Column, query: str) -> Column:
    """Every word of the query occurs in the blob; an empty query matches all."""
    tests = [F.contains(blob, F.lit(w)) for w in query.lower().split()]
    return reduce(Column.__and__, tests, F.lit(True))


def enrich(records: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Records plus what search needs: colleges, depts, blob, topics (a bit for each pattern, TOPICS' by default), initials and rich (0 to 4)."""
    fallback = F.array(F.struct("college", "department"))
    plain = F.transform("affiliations", lambda a: F.struct(a["college"].alias("college"), a["department"].alias("department")))
    affs = F.when(F.size("affiliations") > 0, plain).otherwise(fallback)
    listed = lambda name: F.array_distinct(F.filter(F.transform(affs, lambda a: a[name]), lambda x: x.isNotNull() & (x != "")))
    filled = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    blob = search_blob([
        *[present(F.col(c)) for c in ("name", "title", "department", "college", "lab_name")],
        *[filled(c) for c in ("research_areas", "teaching", "extension")], present(F.col("research_summary")), filled("roles"),
        F.transform("current_students", lambda s: present(s["name"])), present(F.col("email")),
    ])
    with_blob = records.withColumns({"colleges": listed("college"), "depts": listed("department"), "blob": blob})
    return with_blob.withColumns({
        "topics": topic_mask(F.col("blob"), patterns or list(TOPICS.values())),
        "initials": initials(F.col("name")),
        "rich": richness([
            present(F.col("email")).isNotNull(), F.size("research_areas") > 0, present(F.col("google_scholar")).isNotNull(), F.size("teaching") > 0
        ]),
    })


def search(
    enriched: DataFrame, query: str = "", college: str = "", department: str = "", topic: int = -1,
    only: tuple[str, ...] = (), limit: int | None = PAGE, page: int = 1, patterns: list[str] | None = None,
) -> DataFrame:
    """All conditions together; browsing (no query) puts full records first, a query keeps the published order ``ord``.

    only: of email, scholar, students and research. topic: the number of a pattern, of which only that one is tried, and only
    on records that meet the other conditions. ``page`` counts from 1.
    """
    flags = {
        "email": present(F.col("email")).isNotNull(), "scholar": present(F.col("google_scholar")).isNotNull(),
        "students": F.size("current_students") > 0, "research": F.size("research_areas") > 0,
    }
    tests = [flags[o] for o in only]
    if college:
        tests.append(F.array_contains("colleges", college))
    if department:
        tests.append(F.array_contains("depts", department))
    tests.append(matches_query(F.col("blob"), query))
    if topic >= 0:
        tests.append(F.regexp_like("blob", F.lit((patterns or list(TOPICS.values()))[topic])))
    found = enriched.where(reduce(Column.__and__, tests))
    ordered = found.orderBy("ord") if query else found.orderBy(F.desc("rich"), F.collate("name", "UNICODE"), "id")
    return ordered.offset((page - 1) * limit).limit(limit) if limit else ordered


def lookup(enriched: DataFrame, record_id: str) -> DataFrame:
    return enriched.where(F.col("id") == record_id).limit(1)


def card(enriched: DataFrame) -> DataFrame:
    """What a result card shows, with its fall-backs."""
    return enriched.select(
        "id", "name", F.coalesce(present(F.col("title")), F.lit("Faculty")).alias("title"),
        F.coalesce(present(F.col("department")), present(F.col("college")), F.lit("")).alias("place"), F.slice("research_areas", 1, 3).alias("tags"),
    )


def facet_tree(df: DataFrame, group: Column, values: Column) -> DataFrame:
    """``(group, members)``: all different values of the rows that name a group, sorted; a row's groups all get all of its values."""
    pairs = df.select(F.explode(group).alias("group"), values.alias("v")).select("group", F.explode_outer("v").alias("v"))
    return pairs.groupBy("group").agg(F.array_sort(F.collect_set("v")).alias("members"))


def departments_of(tree: DataFrame, group: str = "") -> DataFrame:
    """The departments of a college, or of all."""
    chosen = tree.where(F.col("group") == group) if group else tree
    return chosen.select(F.explode("members").alias("department")).distinct().orderBy("department")


def csv_rows(enriched: DataFrame) -> tuple[str, DataFrame]:
    """The export's header line and a column ``line`` for each record, in order of ``ord``."""
    labels = [
        "Name", "Title", "College", "Department", "Email", "Research areas", "Teaching", "Extension", "Google Scholar", "Lab",
        "Profile", "Current students",
    ]
    joined = lambda c: F.array_join(c, "; ")
    students = F.transform(
        "current_students",
        lambda s: F.concat(s["name"], F.when(present(s["program"]).isNotNull(), F.concat(F.lit(" ("), s["program"], F.lit(")"))).otherwise("")),
    )
    cells = [
        *[F.col(c) for c in ("name", "title", "college", "department", "email")], *[joined(F.col(c)) for c in ("research_areas", "teaching", "extension")],
        F.col("google_scholar"), F.col("lab_url"), F.col("profile_url"), joined(students),
    ]
    header = ",".join('"' + x + '"' for x in labels)
    return header, enriched.select("ord", to_csv_line(*cells).alias("line"))


def kpis(enriched: DataFrame) -> DataFrame:
    """Records, colleges, departments and the last update, as one row."""
    facts = enriched.agg(F.count(F.lit(1)).alias("records"), F.max("verified_at").alias("updated"))
    colleges = enriched.select(F.explode("colleges").alias("c")).agg(F.countDistinct("c").alias("colleges"))
    depts = enriched.select(F.explode("depts").alias("d")).agg(F.countDistinct("d").alias("departments"))
    return facts.crossJoin(colleges).crossJoin(depts)

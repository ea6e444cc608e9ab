"""Coverage reports and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.resolve import explode_membership


def count_where(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def coverage_by(units: DataFrame, members: DataFrame, on: str, flags: dict[str, Column]) -> DataFrame:
    """Every unit, also those without members, with its members and how many of them meet each flag.

    Members are counted by unit before the join, so the join moves a row a unit.
    """
    counted = members.groupBy(on).agg(F.count(F.lit(1)).alias("members"), *[count_where(f).alias(n) for n, f in flags.items()])
    joined = units.join(counted, on, "left")
    return joined.select(*units.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", *flags)])


def members_of_units(records: DataFrame, department: str = "department", affiliations: str = "affiliations") -> DataFrame:
    """Records by each different unit that they name, as their department or in an affiliation, as ``unit``."""
    return explode_membership(records, department, F.transform(affiliations, lambda a: a["department"]))


def coverage_by_group(units: DataFrame, records: DataFrame, group: str = "college", status: str = "status", order: str = "ord") -> DataFrame:
    """``(group, ord, departments, records, departments_ok)``: the units of each group, those that are ok, and the records of the group itself."""
    own = units.groupBy(group).agg(F.min(order).alias("ord"), F.count(F.lit(1)).alias("departments"), count_where(F.col(status) == "ok").alias("departments_ok"))
    counted = records.groupBy(group).agg(F.count(F.lit(1)).alias("records"))
    return own.join(counted, group, "left").select(group, "ord", "departments", F.coalesce("records", F.lit(0)).alias("records"), "departments_ok")


def coverage_levels(records: DataFrame, flags: dict[str, Column], department: str = "department", college: str = "college", affiliations: str = "affiliations") -> DataFrame:
    """``(level, name, members, ..flags)`` of units, colleges and the whole, in one pass and one shuffle.

    The levels count by different rules: a unit counts the records that name it as department or in an affiliation, a
    college those whose own it is, the level ``all`` every record (name: empty). So each record is spread to what it counts for, which are
    the grouping sets of these rules, and partial sums of a row a name are all that moves. Blank names have no row; what
    has no members has none either (see ``coverage_by`` for a report with all units).
    """
    units = F.array_distinct(F.concat(F.array(F.col(department)), F.coalesce(F.transform(affiliations, lambda a: a["department"]), F.array().cast("array<string>"))))
    of = lambda level, names: F.transform(F.filter(names, lambda u: u.isNotNull() & (u != "")), lambda u: F.struct(F.lit(level).alias("level"), u.alias("name")))
    sets = F.concat(of("unit", units), of("college", F.array(F.col(college))), F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("name"))))
    spread = records.select(*[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()], F.explode(sets).alias("set"))
    return spread.groupBy("set.level", "set.name").agg(F.count(F.lit(1)).alias("members"), *[F.count_if(F.col(n)).alias(n) for n in flags])


def record_flags() -> dict[str, Column]:
    """What a report counts of records."""
    return {
        "with_email": F.col("email") != "", "with_scholar": F.col("google_scholar") != "", "with_research": F.size("research_areas") > 0,
        "with_teaching": F.size("teaching") > 0,
    }


def coverage_document(units: DataFrame, records: DataFrame, students: DataFrame, facts: dict[str, str], errors: DataFrame | None = None, max_units: int = 100_000, max_errors: int = 300) -> DataFrame:
    """One row, the report as nested columns: facts, status_counts, colleges, departments, totals, errors.

    units: (ord, college, department, site, status, faculty_page, faculty_listed, students_found, ..), tens of thousands at
    most (more are refused: the document is one value); errors: (url, error), of which the first ``max_errors`` are kept.
    """
    n = units.count()
    if n > max_units:
        raise ValueError(f"{n} units are too many for one document")
    flags = record_flags()
    per_unit = coverage_by(units.withColumnRenamed("department", "unit"), members_of_units(records), "unit", flags)
    in_turn = lambda cols: F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), F.struct(*cols).alias("r")))), lambda x: x["r"])
    rows = [F.col("unit").alias("department"), F.col("members").alias("faculty_in_database"), *[c for c in per_unit.columns if c not in ("ord", "unit", "members")]]
    departments = per_unit.agg(in_turn(rows).alias("departments"))
    colleges = coverage_by_group(units, records).agg(in_turn([F.col("college").alias("name"), "departments", F.col("records").alias("faculty"), "departments_ok"]).alias("colleges"))
    counts = status_counts(units).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    whole = totals(records, {**flags, "with_students": F.size("current_students") > 0, "with_college": F.col("college") != ""})
    listed = students.agg(F.count(F.lit(1)).alias("n_students"))
    total = whole.crossJoin(listed).select(
        F.struct(F.col("members").alias("faculty"), F.col("n_students").alias("students"), *[c for c in whole.columns if c != "members"]).alias("totals")
    )
    out = counts.crossJoin(colleges).crossJoin(departments).crossJoin(total)
    if errors is not None:
        out = out.crossJoin(errors.limit(max_errors).agg(F.collect_list(F.struct("url", F.left("error", F.lit(200)).alias("error"))).alias("errors")))
    return out.select(*[F.lit(v).alias(k) for k, v in facts.items()], "*")


def totals(members: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return members.agg(F.count(F.lit(1)).alias("members"), *[count_where(f).alias(n) for n, f in flags.items()])


def progress_percent(stage: Column, done: Column, total: Column) -> Column:
    """Percent done, piecewise by stage: units to 5, departments to 20, profiles to 92, the rest to 94, then 100."""
    share = F.when(total > 0, done / total).otherwise(0.0)
    bands = {"units": (1, 4), "departments": (5, 15), "profiles": (20, 72), "merge": (92, 2), "done": (100, 0)}
    percent = F.lit(0.0)
    for name, (start, width) in bands.items():
        percent = F.when(stage == name, start + width * share).otherwise(percent)
    return F.round(percent, 1)


def eta_seconds(elapsed: Column, percent: Column) -> Column:
    return F.when((percent >= 8) & (percent < 99), elapsed * (100 - percent) / percent)


# What a publication needs at least.
GATES = {"records": 3000, "units_with_site": 60, "units_ok": 25, "enriched": 300}


def quality_gate(records: DataFrame, units: DataFrame, declared: int | None = None, least: dict[str, int] | None = None) -> DataFrame:
    """``(gate, value, least, ok)``: counts against their minima, ids unique, and the declared total the real one."""
    least = {**GATES, **(least or {})}
    r = records.agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("id").alias("ids"),
        count_where((F.col("profile_url") != "") & ((F.size("research_areas") > 0) | (F.col("email") != ""))).alias("enriched"),
    )
    u = units.agg(count_where(F.col("site") != "").alias("units_with_site"), count_where(F.col("status") == "ok").alias("units_ok"))
    row = r.crossJoin(u)
    gates = [F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(n).cast("long").alias("least"), (F.col(g) >= n).alias("ok")) for g, n in least.items()]
    gates.append(F.struct(F.lit("unique_ids").alias("gate"), F.col("ids").alias("value"), F.col("records").alias("least"), (F.col("ids") == F.col("records")).alias("ok")))
    if declared is not None:
        gates.append(F.struct(F.lit("declared").alias("gate"), F.col("records").alias("value"), F.lit(declared).cast("long").alias("least"), (F.col("records") == declared).alias("ok")))
    return row.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def require(gates: DataFrame) -> None:
    """Raises if a gate is not met."""
    failed = [f"{r['gate']}: {r['value']} of {r['least']}" for r in gates.where("not ok").collect()]
    if failed:
        raise ValueError("quality gate: " + "; ".join(failed))

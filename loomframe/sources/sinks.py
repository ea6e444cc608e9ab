"""Sinks: JSON documents and CSV text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.text import last_name


def published_order(records: DataFrame) -> list:
    return [last_name(F.col("name")), F.col("name"), F.col("id")]


def json_lines(records: DataFrame, path: str) -> None:
    """One compact JSON object a line, sorted by surname over all files; fields that are null are left out."""
    ordered = records.orderBy(*published_order(records))
    ordered.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").text(path)


def json_document(records: DataFrame, metadata: dict[str, str], path: str, field: str = "faculty", max_rows: int = 1_000_000) -> str:
    """The whole table as one JSON object, {metadata, field: [...]}, and its revision.

    For tables that a browser loads; above ``max_rows`` it raises, and ``json_lines`` is the way.
    """
    n = records.count()
    if n > max_rows:
        raise ValueError(f"{n} rows are too many for one document; use json_lines")
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(published_order(records))])
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("o"), F.struct(*records.columns).alias("r"))))
    meta = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), F.lit(v))])
    body = records.agg(F.to_json(F.struct(meta.alias("metadata"), F.transform(listed, lambda x: x["r"]).alias(field))).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)
    spark = records.sparkSession
    return spark.read.text(path, wholetext=True).select(F.substring(F.sha1(F.rtrim(F.col("value"))), 1, 10)).first()[0]


def meta_document(records: DataFrame, students: DataFrame, updated_at: str, revision: str) -> DataFrame:
    """One row: counts and the content's revision."""
    units = records.select(F.explode("affiliations").alias("a"))
    r = records.agg(F.count(F.lit(1)).alias("faculty"))
    s = students.agg(F.count(F.lit(1)).alias("students"))
    u = units.agg(F.countDistinct(F.nullif("a.college", F.lit(""))).alias("colleges"), F.countDistinct(F.nullif("a.department", F.lit(""))).alias("departments"))
    return r.crossJoin(s).crossJoin(u).select(F.lit(updated_at).alias("updated_at"), F.lit(revision).alias("revision"), "*")


def csv_text(lines: DataFrame, header: str, path: str) -> None:
    """Lines (ord, line) below a header, in order, ended by CRLF, as one file: the export of what a person has filtered.

    The text itself is written, so that line feeds in cells stay. One task writes it; for whole tables use Spark's CSV writer.
    """
    head = lines.sparkSession.createDataFrame([(-1, header)], "ord long, line string")
    head.union(lines.select(F.col("ord").cast("long"), "line")).orderBy("ord").select("line").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def coverage_json(document: DataFrame, path: str) -> None:
    """The one row of ``coverage_document`` as a JSON file."""
    document.select(F.to_json(F.struct(*document.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)

"""Published tables: results kept by unit and rerun in part, and snapshots that are read by version."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomframe.session import erase, written

FAILED = ("unreachable", "error")  # fixed values: states of a unit that a second run may mend
STALE_DAYS = 110  # fixed value: a snapshot older than this is due for a refresh
MANIFEST = "version long, revision string, published_at string, rows long, path string, schema string, facts map<string,string>"


# Results by unit


def unit_results(units: DataFrame, people: DataFrame, by: str = "unit_id") -> DataFrame:
    """A row for each of ``people`` with its unit's columns, and a row of nulls for each unit without people.

    units: (by, status, ..), one row each; people: (by, ..), other names. Every unit has a row, so rewriting a unit's
    partition also empties it.
    """
    return units.join(people, by, "left")


def _placed(results: DataFrame, by: str):
    # Rebalanced by unit: small units share a task, and a unit that holds a third of all rows is split over several.
    return results.hint("rebalance", by).write.partitionBy(by).mode("overwrite")


def write_results(results: DataFrame, path: str, by: str = "unit_id") -> None:
    """All results, a partition of ``path`` for each unit; units are named by non-empty values."""
    _placed(results, by).parquet(path)


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The results at ``path`` with the columns of ``schema`` (that of what was written), in its order."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def failed_units(results: DataFrame, by: str = "unit_id", status: str = "status", failed: tuple[str, ...] = FAILED) -> DataFrame:
    """The units to be run again."""
    return results.where(F.col(status).isin(*failed)).select(by).distinct()


def rerun_units(again: DataFrame, path: str, by: str = "unit_id", status: str = "status", person: str = "person", failed: tuple[str, ...] = FAILED) -> DataFrame:
    """Merge the results of a second run into those at ``path``, and return the whole.

    A unit's new result takes the place of its old one if it did not fail, or if it found more people (rows whose ``person`` is
    not null); else the old one stays. Units that are new are added. Only the partitions of units that change are
    rewritten, by dynamic partition overwrite; those of all others are not touched, nor read but for the columns that
    decide.
    """
    spark = again.sparkSession

    def told(results: DataFrame, state: str, found: str) -> DataFrame:
        return results.groupBy(by).agg(F.max(status).alias(state), F.count(person).alias(found))

    fresh = written(again, "rerun")
    old = read_results(spark, path, again.schema)
    before = told(old.join(F.broadcast(fresh.select(by).distinct()), by, "left_semi"), "was", "had")
    judged = told(fresh, "state", "found").join(before, by, "left")
    better = ~F.coalesce(F.col("state").isin(*failed), F.lit(False)) | F.col("had").isNull() | (F.col("found") > F.col("had"))
    taken = written(judged.where(better).select(by), "rerun-taken")
    _placed(fresh.join(taken, by, "left_semi").select(*again.columns), by).option("partitionOverwriteMode", "dynamic").parquet(path)
    erase(fresh, taken)
    spark.catalog.refreshByPath(path)
    return read_results(spark, path, again.schema)


# Snapshots


def content_revision(table: DataFrame) -> str:
    """Ten hex digits that stand for a table's rows, whatever their order and partitions: the start of a SHA-1 over their number and sums of their hashes."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]
    told = table.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(s, F.lit(0)).alias(f"s{i}") for i, s in enumerate(sums)])
    return told.select(F.substring(F.sha1(F.concat_ws(":", "n", "s0", "s1").cast("binary")), 1, 10)).first()[0]


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The versions published under ``root``, a row each; none where nothing was. An entry that cannot be read is left out."""
    fs, target = _files(spark, f"{root}/manifest")
    if not fs.exists(target):
        return spark.createDataFrame([], MANIFEST)
    entries = spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{root}/manifest")
    return entries.where("version is not null and path is not null")


def load_meta(spark: SparkSession, root: str) -> dict | None:
    """The newest version's entry, or None where there is none."""
    newest = manifest(spark, root).orderBy(F.desc("version")).limit(1).collect()
    return newest[0].asDict() if newest else None


def publish(table: DataFrame, root: str, facts: dict[str, str] | None = None, published_at: str | None = None) -> dict:
    """Publish ``table`` as the next version under ``root``; returns its entry of the manifest.

    The rows are written beside all versions, and become one when the entry of the next number is renamed into the manifest,
    which fails if another has taken that number (it is then tried with the next). Readers see whole versions only, and
    versions never change. A table whose content equals that of the newest version is not published again.
    """
    spark = table.sparkSession
    revision, last = content_revision(table), load_meta(spark, root)
    if last and last["revision"] == revision:
        return last
    path = f"{root}/data/{revision}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    stamp = published_at or datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
    entry = {
        "revision": revision, "published_at": stamp, "rows": spark.read.schema(table.schema).parquet(path).count(), "path": path, "schema": table.schema.json(),
        "facts": facts or {},
    }
    number = (last["version"] if last else 0) + 1
    while True:
        entry["version"] = number
        fs, draft = _files(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, place = _files(spark, f"{root}/manifest/{number:012d}.json")
        if not fs.exists(place) and fs.rename(draft, place):
            return entry
        fs.delete(draft, False)
        number += 1


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, revision: str | None = None) -> DataFrame:
    """The rows of a version, of a revision (its newest version), or of the newest version. Raises where there is none."""
    found = manifest(spark, root)
    if version is not None:
        found = found.where(F.col("version") == version)
    if revision is not None:
        found = found.where(F.col("revision") == revision)
    entries = found.orderBy(F.desc("version")).limit(1).collect()
    if not entries:
        raise ValueError(f"nothing is published at {root} as version {version}, revision {revision}")
    return spark.read.schema(StructType.fromJson(json.loads(entries[0]["schema"]))).parquet(entries[0]["path"])


def is_stale(meta: dict | None, now: str, days: int = STALE_DAYS) -> bool:
    """Whether what ``load_meta`` gave is due for a refresh at ``now`` (both ISO dates or times); nothing published is."""
    if meta is None:
        return True
    day = lambda s: datetime.date.fromisoformat(s[:10])
    return (day(now) - day(meta["published_at"])).days >= days


def expire(spark: SparkSession, root: str, keep: int = 5) -> int:
    """Delete all but the newest ``keep`` versions: first their entries, then their rows. Returns how many went."""
    old = manifest(spark, root).orderBy(F.desc("version")).offset(keep).select("version", "path").collect()
    for r in old:
        for place in (f"{root}/manifest/{r['version']:012d}.json", r["path"]):
            fs, target = _files(spark, place)
            fs.delete(target, True)
    return len(old)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2
FOLDS = 4
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local does this make a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="loomframe-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Inside this, Python workers get at most so many rows at a time: for rows that are large."""
    return _setting(spark, ARROW_ROWS, str(rows))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here. ``release`` deletes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def materialize_lean(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, and drop the shuffle files of the write as soon as it has ended: for steps that shuffle much."""
    with _setting(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        return materialize(df, label)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` of which nothing that is still to run reads; others are left alone."""
    for df in tables:
        path = getattr(df, "written_to", None) if df is not None else None
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_keys(text_col: str) -> list[Column]:
    """Two independent 64-bit hashes, h1 and h2, that stand for a text (null for a null text: its seed)."""
    text = F.col(text_col).cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4 (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def is_held_out(id_col: Column) -> Column:
    """True for the held-out fold; a null id is never held out (and never learned from)."""
    return F.coalesce(fold_of(id_col) == HELD_OUT_REMAINDER, F.lit(False))


def is_learnable(id_col: Column) -> Column:
    return F.coalesce(fold_of(id_col) != HELD_OUT_REMAINDER, F.lit(False))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))

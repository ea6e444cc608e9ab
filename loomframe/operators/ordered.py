"""Operators for which the order of rows matters; every one takes its ordinal explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.text import present


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, as an aggregate: partial minima are taken before the shuffle."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def _keep(df: DataFrame, keys: list[str], order: list, pick) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*others), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def first_present(col: str, order: Column) -> Column:
    """Aggregate: the first value in order that is not empty, or ''."""
    return F.coalesce(F.min_by(F.col(col), F.when(present(F.col(col)).isNotNull(), order)), F.lit(""))


def ordered_union(arrays: str, order: Column) -> Column:
    """Aggregate: the elements of arrays, array by array in order, each once."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(arrays).alias("a"))))
    return F.array_distinct(F.flatten(F.transform(listed, lambda x: x["a"])))


def carry_forward(value: Column, group: list, order: list) -> Column:
    """Window: the last value that is not null, this row included."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_count(flag: Column, group: list, order: list) -> Column:
    """Window: how often the flag has held so far, this row included."""
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(flag.cast("long")).over(frame)


def look_ahead(value: Column, group: list, order: list, rows: int) -> Column:
    """Window: the first value that is not null in this row and the ``rows - 1`` after it."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(0, rows - 1))


def interleave(df: DataFrame, key: str, order: list, first: Column) -> DataFrame:
    """Adds ``turn`` (the row's number in its key) and ``key_first``: by these two, rows go round robin over the keys."""
    by_key = Window.partitionBy(key)
    return df.withColumns({"turn": F.row_number().over(by_key.orderBy(*order)).cast("long"), "key_first": F.min(first).over(by_key)})


def large_groups(df: DataFrame, scope: list[str], group: str, least: int = 3, share: float = 0.25) -> DataFrame:
    """Groups with at least ``least`` rows and ``share`` of the largest of their scope; all, if the largest has fewer than ``least``."""
    sizes = df.groupBy(*scope, group).agg(F.count(F.lit(1)).alias("n"))
    if scope:
        largest = F.max("n").over(Window.partitionBy(*scope))
        sizes = sizes.withColumn("largest", largest)
    else:
        sizes = sizes.crossJoin(sizes.agg(F.max("n").alias("largest")))
    keep = (F.col("largest") < least) | ((F.col("n") >= least) & (F.col("n") >= F.col("largest") * share))
    return sizes.where(keep)


def top_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")

"""Sharding by a k-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loomframe.llm.common import materialize, release, table, text_or_empty

DIM_BITS = 20
HASH_BITS = 27
ROW_BITS = 16
TIE_BITS = HASH_BITS + ROW_BITS
KEY_BITS = DIM_BITS + TIE_BITS
STEP_BITS = 16
SLOT_BUCKET_ROWS = 4096
MAX_DEPTH = 60
ROW = "__loomframe_row"


def size_of(text: Column) -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + 1


def identity_of(row_id: Column, text: Column) -> Column:
    """A hash that tells documents apart: of id and text."""
    return F.xxhash64(row_id.cast("string"), text_or_empty(text))


def _raw_dim(docs: DataFrame, name: str, size: Column) -> Column:
    """A dimension as a number: the logarithm of the size, numbers as they are, texts by their first six bytes, in their order."""
    if name == "size":
        return F.log2(size.cast("double"))
    if isinstance(docs.schema[name].dataType, NumericType):
        value = F.col(name).cast("double")
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    start = F.substring(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 1, 6)
    return F.conv(F.rpad(F.hex(start), 12, "0"), 16, 10).cast("double")


def _scaled(raw: Column, low: float | None, high: float | None) -> Column:
    """A dimension as an integer of DIM_BITS bits; nulls take the low end."""
    if low is None or high is None or high <= low:
        return F.lit(0).cast("long")
    top = (1 << DIM_BITS) - 1
    return F.coalesce(F.floor((raw - low) / (high - low) * top), F.lit(0)).cast("long")


def _medians(narrow: DataFrame, goals: DataFrame, n_dims: int, tolerance: float) -> DataFrame:
    """``(node, threshold)``, so that the weight of the node's rows whose key lies below is nearest its goal.

    goals: (node, dim, goal, total). Each round sums weights by node and by bucket of STEP_BITS bits and goes on inside the
    bucket that the goal falls in, until that holds a ``tolerance`` of the node's weight; a node's histogram has at most
    2**STEP_BITS rows, whatever the input, and that is what a task of the running sum sees of it.
    """
    keyed = narrow.join(goals.select("node", "dim"), "node").select(
        "node", F.get(F.array(*[F.col(f"k{j}") for j in range(n_dims)]), F.col("dim")).alias("key"), "size"
    )
    state = goals.select("node", "goal", "total", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"))
    run = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    found, rounds, bits = [], [], KEY_BITS
    while bits:
        shift = max(0, bits - STEP_BITS)
        inside = keyed.join(state.select("node", "prefix"), "node").where(F.shiftright("key", bits) == F.col("prefix"))
        sums = inside.groupBy("node", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("weight"))
        upto = sums.select("node", "bucket", "weight", F.sum("weight").over(run).alias("upto")).join(state, "node")
        hit = upto.where(F.col("before") + F.col("upto") >= F.col("goal")).groupBy("node", "goal", "total").agg(
            F.min(F.struct("bucket", "weight", (F.col("before") + F.col("upto") - F.col("weight")).alias("start"))).alias("h")
        )
        nearer_start = F.col("goal") - F.col("h.start") <= F.col("h.start") + F.col("h.weight") - F.col("goal")
        at = F.col("h.bucket") + F.when(nearer_start, 0).otherwise(1)
        done = (F.lit(shift) == 0) | (F.col("h.weight") <= tolerance * F.col("total"))
        told = hit.select("node", "goal", "total", F.col("h.bucket").alias("prefix"), F.col("h.start").alias("before"), F.shiftleft(at, shift).alias("threshold"), done.alias("done"))
        told = materialize(told, "shard-median")
        rounds.append(told)
        found.append(told.where("done").select("node", "threshold"))
        state, bits = told.where("not done").select("node", "goal", "total", "prefix", "before"), shift
        if state.isEmpty():
            break
    thresholds = materialize(reduce(DataFrame.union, found), "shard-thresholds")
    release(*rounds)
    return thresholds


def _leaves(narrow: DataFrame, n_dims: int, n_shards: int, target_bytes: int | None, tolerance: float) -> DataFrame:
    """``(row, shard, tie)`` of ``narrow(row, size, k0.., tie)``: splits all open nodes of a level together, until none is open."""
    spark = narrow.sparkSession
    narrow = narrow.withColumn("node", F.lit(0).cast("long"))
    nodes = spark.createDataFrame([(0, 0, n_shards, -1)], "node long, first int, shards int, rows_above long")
    closed, used = [], []
    widths = [(F.shiftright(F.max(f"k{j}"), TIE_BITS) - F.shiftright(F.min(f"k{j}"), TIE_BITS)).alias(f"w{j}") for j in range(n_dims)]
    widest = F.get(F.transform(F.array_sort(F.array(*[F.struct((-F.col(f"w{j}")).alias("w"), F.lit(j).alias("j")) for j in range(n_dims)])), lambda s: s["j"]), F.lit(0))
    for depth in range(MAX_DEPTH):
        stats = narrow.groupBy("node").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"), *widths).join(nodes, "node")
        if target_bytes:  # a node that its parent's split left whole cannot be split
            want = F.ceil(F.col("total") / target_bytes).cast("int")
            stats = stats.withColumn("shards", F.when((F.col("n") > 1) & (F.col("n") != F.col("rows_above")), want).otherwise(1))
        left = F.floor(F.col("shards") / 2).cast("int")
        stats = stats.select("node", "first", "shards", "n", "total", widest.alias("dim"), left.alias("left"), (F.col("total") * left / F.col("shards")).alias("goal"))
        stats = materialize(stats, "shard-nodes")
        goals = stats.where("shards > 1")
        leaf = stats.where("shards <= 1").select("node", "first", F.shiftleft(F.col("node") + 1 - (1 << depth), MAX_DEPTH - depth).alias("place"))
        closed.append(leaf)
        used.append(stats)
        if goals.isEmpty():
            break
        thresholds = _medians(narrow, goals.select("node", "dim", "goal", "total"), n_dims, tolerance)
        chosen = goals.join(thresholds, "node").select("node", "dim", "threshold")
        key = F.get(F.array(*[F.col(f"k{j}") for j in range(n_dims)]), F.col("dim"))
        below = F.when(F.col("threshold").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(key < F.col("threshold"), 1).otherwise(2))
        own = ["row", "size", *[f"k{j}" for j in range(n_dims)], "tie"]
        moved = materialize(narrow.join(chosen, "node", "left").select(*own, below.alias("node")), "shard-level")
        if depth:
            release(narrow)
        release(thresholds)
        narrow = moved
        sides = F.array(
            F.struct((F.col("node") * 2 + 1).alias("node"), F.col("first").alias("first"), F.col("left").alias("shards")),
            F.struct((F.col("node") * 2 + 2).alias("node"), (F.col("first") + F.col("left")).alias("first"), (F.col("shards") - F.col("left")).alias("shards")),
        )
        nodes = goals.select(F.explode(sides).alias("s"), "n").select("s.node", "s.first", "s.shards", F.col("n").alias("rows_above"))
    ends = reduce(DataFrame.union, closed)
    if target_bytes:  # numbered along the tree; one row a shard, so one task can
        ends = ends.withColumn("first", (F.row_number().over(Window.orderBy("place")) - 1).cast("int"))
    placed = materialize(narrow.join(ends.select("node", F.col("first").alias("shard")), "node").select("row", "shard", "tie"), "shard-leaves")
    release(*used, narrow)
    return placed


def shard_documents(
    docs: DataFrame,
    n_shards: int | None = 16,
    target_bytes: int | None = None,
    dims: tuple[str, ...] = ("lang", "source", "size"),
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 1e-4,
    size: Column | None = None,
    identity: Column | None = None,
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard) to ``docs``.

    Method: a k-d tree. Every node is split at the weighted median (weights: UTF-8 bytes plus 1, or ``size``) along the
    metadata dimension in which its rows spread widest, until there is a leaf a shard (``n_shards``) or, with
    ``target_bytes``, until every leaf holds at most so many bytes or a single row. All nodes of a level are handled together,
    by grouped sums and joins with the table of nodes, so the number of leaves is not bounded. Each dimension's key ends in a
    hash of id and text (or of ``identity``) and then of the row, so a value, or a row, that a third of all rows repeat still
    splits evenly. Slots come from row numbers in small hash buckets plus running bucket counts, so no task holds a shard.

    The rows are written once with numbers of their own; the tree works on narrow rows, which then give each its shard.
    Nulls: a null text counts one byte; null metadata counts as empty text or the lowest number. An empty table gives an
    empty result. Columns named ``shard`` or ``slot`` are replaced; others stay. Missing dimensions are skipped.
    """
    dims = tuple(d for d in dims if d == "size" or d in docs.columns)
    rest = docs.drop("shard", "slot")
    rows = materialize(rest.withColumn(ROW, F.monotonically_increasing_id()), "shard-rows")
    size = size_of(F.col(text_col)) if size is None else size
    identity = identity_of(F.col(id_col), F.col(text_col)) if identity is None else identity
    low_bits = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1))
    tie = F.shiftleft(low_bits(identity, HASH_BITS), ROW_BITS).bitwiseOR(low_bits(F.xxhash64(ROW), ROW_BITS))
    raw = [_raw_dim(docs, d, size).alias(f"r{j}") for j, d in enumerate(dims)]
    base = materialize(rows.select(F.col(ROW).alias("row"), size.alias("size"), tie.alias("tie"), *raw), "shard-narrow")
    bounds = base.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("total"),
        *[f(f"r{j}").alias(f"{f.__name__}{j}") for j in range(len(dims)) for f in (F.min, F.max)],
    ).first()
    if not bounds["n"]:
        return rest.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).where(F.lit(False))
    scaled = [_scaled(F.col(f"r{j}"), bounds[f"min{j}"], bounds[f"max{j}"]) for j in range(len(dims))] or [F.lit(0).cast("long")]
    keys = [F.shiftleft(c, TIE_BITS).bitwiseOR(F.col("tie")).alias(f"k{j}") for j, c in enumerate(scaled)]
    if target_bytes:
        n_shards = max(1, math.ceil(bounds["total"] / target_bytes))
    placed = _leaves(base.select("row", "size", *keys, "tie"), len(keys), n_shards, target_bytes, tolerance)
    n_buckets = max(1, math.ceil(bounds["n"] / n_shards / SLOT_BUCKET_ROWS))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "row"))
    slots = placed.withColumn("number", number).join(offsets, ["shard", "bucket"])
    slots = slots.select(F.col("row").alias(ROW), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))
    release(base)
    return rows.join(slots, ROW).select(*rest.columns, "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    # measured before the rows are written, so the texts themselves need not be
    measured = docs.select(
        "doc_id", "lang", "source", size_of(text).alias("size"), F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        identity_of(F.col("doc_id"), text).alias("identity"),
    )
    sharded = shard_documents(measured, n_shards=16, size=F.col("size"), identity=F.col("identity"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""SimHash near-duplicates through a segment-popcount grid."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import materialize, release, table, text_or_empty
from loomframe.llm.graph import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
GRIDS = (4, 2, 1)  # bits a segment
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15


def simhash(text: bytes) -> int:
    """Fingerprint of a UTF-8 text as a signed 64-bit number; no words: zero."""
    words = text.translate(_LOWER).split()  # bytes.split() cuts at x20 and x09 to x0D only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE_WORDS:
        starts, ends = [0], [len(joined)]
    else:
        stops = list(accumulate(len(w) + 1 for w in words))
        starts, ends = [0, *stops[: n - SHINGLE_WORDS]], [e - 1 for e in stops[SHINGLE_WORDS - 1 :]]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype="int64")

    return udf(text_or_empty(text).cast("binary"))


def popcount_cell(fp: Column, width: int) -> Column:
    """The bit counts of the segments of ``width`` bits (4, 2 or 1), packed into a long, ``width`` bits each."""
    if width == 1:
        return fp
    low, half = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    # two-bit counts: without a carry out of the long, which ANSI arithmetic would refuse
    pairs = fp.bitwiseXOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))
    if width == 2:
        return pairs
    return pairs.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x3333333333333333))


def _near_cells(cell: Column, width: int) -> Column:
    """The cell and all cells one step from it in Manhattan distance."""
    steps, mask = [cell], (1 << width) - 1
    if width == 1:
        steps += [cell.bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)]
        return F.array(*steps)
    for s in range(0, 64, width):
        count = F.shiftrightunsigned(cell, s).bitwiseAND(F.lit(mask))
        others = mask << s ^ (1 << 64) - 1
        without = cell.bitwiseAND(F.lit(others - (others >> 63 << 64)))
        steps += [F.when(count < width, without.bitwiseOR(F.shiftleft(count + 1, s))), F.when(count > 0, without.bitwiseOR(F.shiftleft(count - 1, s)))]
    return F.filter(F.array(*steps), lambda c: c.isNotNull())


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``nodes(fp)``, distinct -> edges ``(u, v)`` that connect all fingerprints within two bits of one another.

    The Manhattan distance of the segments' bit counts is at most the Hamming distance, so fingerprints within two bits lie
    within two steps on the grid of count vectors and so share a cell that is at most one step from either. A cell of two
    gives a pair, verified by its differing bits. Fingerprints of cells with more members are joined again on a finer grid:
    first 16 segments, then 32, then 64. On the finest a cell is a fingerprint and its members, 65 at most, lie within one
    bit of it, so any two of them are within two bits, and each is linked to the smallest. That is exact, emits no pairs of
    a crowd, and has no caps. Links that follow from others are not all listed.
    """
    # A small table has few files: spread over all tasks (by number, so that none are joined again) before each row gives dozens of cells.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, used, left = [], [], nodes.select("fp").repartition(tasks, "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE
    for width in GRIDS[:-1]:
        spread = left.select("fp", F.explode(_near_cells(popcount_cell(F.col("fp"), width), width)).alias("cell"))
        cells = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
        cells = materialize(cells, f"cells-{width}")
        found.append(cells.where("n = 2").where(near).select("u", "v"))
        crowd = materialize(spread.join(cells.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct(), "crowd")
        used += [cells, crowd]
        left = crowd.repartition(tasks, "fp")
    spread = left.select("fp", F.explode(_near_cells(F.col("fp"), 1)).alias("cell"))
    met = spread.groupBy("cell").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").where(near)
    links = materialize(reduce(DataFrame.union, [*found, stars]).distinct(), "links")
    release(*used)
    return links


def components_of(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``prints(id, fp)`` -> ``(fp, component_id)``: the smallest id reachable over links of at most two bits."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    roots = materialize(connected_components(fingerprint_links(nodes.select("fp"))), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.where("fp <> root").select("fp", "root").join(smallest, "root").select("fp", "component_id")
    told = materialize(linked.union(smallest.select(F.col("root").alias("fp"), "component_id")), "components")
    release(nodes, roots)
    return told


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fp`` (long) and ``component_id``.

    Words are runs of characters other than x20 and x09 to x0D in the whole lower-cased (A-Z) text; a fingerprint bit is
    set if over half of the three-word shingles' XXH64 have it. Null and empty texts have fingerprint zero, linked like
    any other. A null id takes part; a component's id is null only if all its ids are. Repeated rows give repeated rows.
    """
    prints = materialize(docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    return prints.join(components_of(prints, id_col), "fp").select(id_col, "fp", "component_id")


KEY, TEXT, ROW = (f"__loomframe_{c}" for c in ("key", "text", "row"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id (nulls last), then smallest hashes of text and of the whole row.

    Fully repeated rows count as one. All columns stay as they are; columns that no hash can take (maps) do not enter the last of these.
    """
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    own = {
        KEY: F.coalesce(F.col(id_col).cast("string"), F.lit("\0")),
        TEXT: F.xxhash64(F.col(text_col)),
        ROW: F.xxhash64(*[F.col(f"`{c}`") for c in hashable]),
    }
    prints = materialize(
        docs.select(F.col(id_col).alias("id"), *[c.alias(name) for name, c in own.items()], fingerprint(F.col(text_col)).alias("fp")), "fingerprints"
    )
    # Few fingerprints stand for many rows: each gives its first row, then each component the first of those.
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col(TEXT), F.col(KEY), F.col(ROW)))
    heads = materialize(prints.groupBy("fp").agg(first.alias("head")), "heads")
    roots = materialize(connected_components(fingerprint_links(heads.select("fp"))), "roots")
    kept = (
        heads.join(roots, heads["fp"] == roots["node"], "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("head").alias("head"))
        .select(*[F.col("head")[name].alias(name) for name in own])
    )
    kept = materialize(kept, "kept")
    release(prints, heads, roots)
    return docs.withColumns(own).join(kept, list(own), "left_semi").dropDuplicates(list(own)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

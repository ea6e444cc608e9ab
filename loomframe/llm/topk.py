"""Exact top-k inner products by best-first search of an M-tree kept in pages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import arrow_rows, materialize, release, table

PAGE_ROWS = 512
FANOUT = 256
LEAF_PAGES = 8  # a node of more pages than this is split further
MAX_LEVELS = 6
SPLIT_ROWS = 20_000
BLOCK_QUERIES = 16_384
PAGES_A_BATCH = 128
MAX_BROADCAST_BYTES = 32 << 20
NO_ID = (1 << 63) - 1  # stands for a null id, after all others
_EXACT = 2.0**53
_FOUND = "q_row long, query_id long, row long, vec_id long, score long"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as array<long>; null if the vector or a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * scale)))


def _stack(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them: what pages store."""
    top = np.abs(x).max(initial=0)
    return x.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    at = squares.argmin(axis=1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(1))


def _distance(a: Column, b: Column) -> Column:
    """Euclidean; a missing component counts as zero."""
    squares = F.zip_with(a, b, lambda x, y: F.pow((F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("double"), 2.0))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


_PLACED = "row long, vec_id long, asks boolean, x array<long>, node long, far double"


def _first_level(rows: DataFrame, dim: int, fanout: int, wanted: int) -> tuple[DataFrame, DataFrame]:
    """All rows at their nearest of at most ``fanout`` sampled vectors, and those nodes."""
    spark = rows.sparkSession
    picked = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, min(fanout, wanted))).collect()
    pivots = np.unique(_stack([r["x"] for r in picked], dim), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at, far = _nearest(_stack(pdf["x"], dim), shared.value)
                yield pdf.assign(node=at + 1, far=far)

    placed = materialize(rows.select("row", "vec_id", "asks", "x").mapInPandas(assign, _PLACED), "level")
    heads = spark.createDataFrame([(i + 1, [int(v) for v in p]) for i, p in enumerate(pivots)], "node long, pivot array<long>")
    sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    step = F.array(F.struct("node", "pivot", F.lit(float("inf")).alias("to_parent"), "radius"))
    return placed, materialize(sizes.join(heads, "node").select("node", "n", "radius", step.alias("path")), "nodes")


def _next_level(rows: DataFrame, wide: DataFrame, dim: int, fanout: int, page_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the wide nodes at the nearest of the pivots sampled inside their own node, and the new nodes.

    A node's rows go in parts of about SPLIT_ROWS, each with the node's pivots, so that no task holds a node.
    """
    sized = rows.join(wide.select("node", "n"), "node")
    wanted = F.least(F.lit(fanout), F.ceil(F.col("n") / page_rows))
    dice = F.pmod(F.xxhash64(F.lit("pivot"), "row", "node"), F.lit(1 << 30)) / float(1 << 30)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("row"), "row"))
    sample = sized.where(dice < 2 * wanted / F.col("n")).withColumn("__rank", rank).where(F.col("__rank") <= wanted)
    pivots = sample.groupBy("node").agg(F.sort_array(F.collect_set("x")).alias("pivots"))
    pivots = materialize(pivots.join(wide, "node"), "pivots")  # read again for the nodes' paths
    parts = F.ceil(F.col("n") / SPLIT_ROWS)
    left = sized.withColumn("part", F.pmod(F.xxhash64("row"), parts)).select("node", "part", "row", "vec_id", "asks", "x", "far")
    right = pivots.select("node", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))

    def assign(key, mine: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if not len(heads):  # no row was sampled: the node stays whole, under a child of its own
            return mine.assign(node=key[0] * (fanout + 1) + 1)[["row", "vec_id", "asks", "x", "node", "far"]]
        at, far = _nearest(_stack(mine["x"], dim), _stack(heads["pivots"].iloc[0], dim))
        return mine.assign(node=key[0] * (fanout + 1) + at + 1, far=far)[["row", "vec_id", "asks", "x", "node", "far"]]

    placed = materialize(left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInPandas(assign, _PLACED), "level")
    own = F.posexplode_outer("pivots").alias("j", "pivot")
    heads = wide.select("node", "path").join(pivots.select("node", "pivots"), "node", "left").select("node", "path", own)
    last = F.element_at("path", -1)
    heads = heads.select(
        (F.col("node") * (fanout + 1) + F.coalesce("j", F.lit(0)) + 1).alias("node"), "path", F.coalesce("pivot", last["pivot"]).alias("pivot"), last["pivot"].alias("above")
    )
    sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    step = F.array(F.struct("node", "pivot", _distance(F.col("pivot"), F.col("above")).alias("to_parent"), "radius"))
    fresh = materialize(sizes.join(heads, "node").select("node", "n", "radius", F.concat("path", step).alias("path")), "nodes")
    release(pivots)
    return placed, fresh


def build_pages(rows: DataFrame, dim: int, k: int, page_rows: int = PAGE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """``rows(row, vec_id, asks, x)`` -> the M-tree's leaf pages.

    Level by level, nodes of more than LEAF_PAGES pages are split among vectors sampled inside them; a node keeps its
    routing vector, its covering radius and its distance to its parent. A page holds up to about ``page_rows`` rows of a leaf
    in order of their distance to the leaf's vector (``far``), and ``path``, the nodes above it. A leaf that cannot be split
    (its vectors are all the same) has as many pages as it needs, dealt by hash, so a vector that a third of all rows share
    spreads. ``asking`` and ``tau`` give the page's query rows and the k-th best score that each has inside the page.
    """
    fanout = max(2, min(fanout, MAX_BROADCAST_BYTES // (8 * dim)))
    n = rows.count()
    placed, nodes = _first_level(rows, dim, fanout, math.ceil(n / page_rows))
    leaves, settled, done = [], [], [placed, nodes]
    for level in range(MAX_LEVELS):
        splits = (F.col("n") > LEAF_PAGES * page_rows) & (F.col("radius") > 0) if level + 1 < MAX_LEVELS else F.lit(False)
        wide = nodes.where(splits)
        settled.append(placed.join(nodes.where(~splits).select("node", "n"), "node"))
        leaves.append(nodes.where(~splits))
        if wide.isEmpty():
            break
        placed, nodes = _next_level(placed, wide, dim, fanout, page_rows)
        done += [placed, nodes]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["far", "row"])
        x = _stack(pdf["x"], dim)
        asking = np.nonzero(pdf["asks"].to_numpy(bool))[0]
        tau = np.full(len(asking), -np.inf)
        if len(x) > k and len(asking):
            scores = _products(x[asking], x)
            scores[np.arange(len(asking)), asking] = np.iinfo(np.int64).min
            tau = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k].astype(float)
        xs = _small(x)
        return pd.DataFrame({
            "node": [int(pdf["node"].iloc[0])], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "far": [pdf["far"].to_numpy(np.float64).tobytes()], "xs": [xs.tobytes()], "kind": [xs.dtype.str], "asking": [[{"row": r, "tau": t} for r, t in zip(pdf["row"].to_numpy(np.int64)[asking].tolist(), tau.tolist())]],
        })

    dealt = reduce(DataFrame.unionByName, settled).withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / page_rows)))
    shape = "node long, rows binary, ids binary, far binary, xs binary, kind string, asking array<struct<row:bigint,tau:double>>"
    pages = dealt.select("node", "part", "row", "vec_id", "asks", "x", "far").groupBy("node", "part").applyInPandas(pack, shape)
    written = materialize(pages.join(reduce(DataFrame.union, leaves).select("node", "path"), "node"), "pages")
    release(*done)
    return written


class Tree:
    """The part of the M-tree above some pages: the nodes on their paths, then the pages themselves as entries."""

    def __init__(self, pages: pd.DataFrame, dim: int):
        at: dict[int, int] = {}
        pivots, self.radius, self.to_parent, self.children, self.page = [], [], [], [], []
        self.tops: list[int] = []
        self.leaf: list[int] = []
        for i, path in enumerate(pages["path"]):
            above = -1
            for step in path:
                j = at.get(step["node"])
                if j is None:
                    j = at[step["node"]] = self._entry(step["radius"], step["to_parent"], -1)
                    pivots.append((j, step["pivot"]))
                    (self.children[above] if above >= 0 else self.tops).append(j)
                above = j
            far = np.frombuffer(pages["far"].iloc[i])
            j = self._entry(float(far[-1]), 0.0, i)
            self.leaf[j] = above
            self.children[above].append(j)
        self.pivots = np.zeros((len(self.page), dim))
        for j, p in pivots:
            self.pivots[j, : len(p)] = p

    def _entry(self, radius: float, to_parent: float, page: int) -> int:
        self.radius.append(radius)
        self.to_parent.append(to_parent)
        self.children.append([])
        self.page.append(page)
        self.leaf.append(-1)
        return len(self.page) - 1


class Search:
    """Best-first search for a block of queries: what they have found so far, and through which bounds they go on.

    <q, x> <= <q, c> + |q| d(c, x). Each query has a queue of entries in order of their bounds. A node enters it with a bound
    from its parent's product and its stored distance to it; only when it comes first is its own product computed. All
    queries take the first of their queues at the same time, and those that meet at an entry are computed together.
    """

    def __init__(self, rows: np.ndarray, xs: np.ndarray, tau: np.ndarray, k: int):
        self.rows, self.xs, self.tau, self.k = rows, xs, tau.copy(), k
        self.norms = np.sqrt((xs**2).sum(1))
        self.found: dict[int, list[tuple[int, int, int]]] = {}
        self.computed = 0  # inner products with rows

    def _slack(self, who, radius: float) -> np.ndarray:
        return 1e-9 * (np.abs(np.nan_to_num(self.tau[who], neginf=0.0)) + self.norms[who] * (1.0 + radius)) + 1e-6

    def visit(self, pages: pd.DataFrame, dim: int) -> None:
        tree = Tree(pages, dim)
        for first in range(0, len(self.rows), 2048):
            self._visit(pages, tree, np.arange(first, min(first + 2048, len(self.rows))), dim)

    def _visit(self, pages: pd.DataFrame, tree: Tree, block: np.ndarray, dim: int) -> None:
        m = len(tree.page)
        queue = np.full((len(block), m), -np.inf)
        product = np.full((len(block), m), np.nan)
        norms = self.norms[block]

        def own_bound(at: np.ndarray, j: int) -> np.ndarray:
            product[at, j] = self.xs[block[at]] @ tree.pivots[j]
            return product[at, j] + norms[at] * tree.radius[j] + self._slack(block[at], tree.radius[j])

        every = np.arange(len(block))
        for j in tree.tops:
            queue[:, j] = own_bound(every, j)
        live = every
        while len(live):
            best = queue[live].argmax(axis=1)
            bound = queue[live, best]
            going = (bound >= self.tau[block[live]]) & (bound > -np.inf)
            live, best = live[going], best[going]
            order = np.argsort(best, kind="stable")
            cuts = np.nonzero(np.diff(best[order]))[0] + 1
            for group in np.split(order, cuts) if len(order) else []:
                at, j = live[group], int(best[group[0]])
                if tree.page[j] >= 0:
                    queue[at, j] = -np.inf
                    self._score(pages.iloc[tree.page[j]], block[at], product[at, tree.leaf[j]], dim)
                    continue
                fresh = np.isnan(product[at, j])
                if fresh.any():  # came by its parent's bound; its own is tighter
                    queue[at[fresh], j] = np.minimum(queue[at[fresh], j], own_bound(at[fresh], j))
                opened = at[~fresh]
                if len(opened):
                    queue[opened, j] = -np.inf
                    for c in tree.children[j]:
                        reach = tree.to_parent[c] + tree.radius[c]
                        queue[opened, c] = product[opened, j] + norms[opened] * reach + self._slack(block[opened], reach)

    def _score(self, page, who: np.ndarray, at_pivot: np.ndarray, dim: int) -> None:
        rows, ids, far = np.frombuffer(page["rows"], np.int64), np.frombuffer(page["ids"], np.int64), np.frombuffer(page["far"])
        xs = np.frombuffer(page["xs"], page["kind"]).reshape(-1, dim).astype(np.float64)
        norms, tau = self.norms[who], self.tau[who]
        # Rows stand in order of distance from the leaf's vector: those nearer than this cannot reach tau.
        need = np.where(norms > 0, (tau - at_pivot) / np.maximum(norms, 1e-300), np.where(at_pivot >= tau, -np.inf, np.inf))
        need -= 1e-9 * np.abs(need, where=np.isfinite(need), out=np.zeros(len(need))) + 1e-6
        start = int(np.searchsorted(far, need.min(initial=np.inf)))
        if start == len(far):
            return
        scores = _products(self.xs[who], xs[start:])
        self.computed += scores.size
        good = (scores >= tau[:, None]) & (rows[start:][None, :] != self.rows[who][:, None])
        for i in np.nonzero(good.any(axis=1))[0]:
            at = np.nonzero(good[i])[0]
            if len(at) > self.k:  # ties at the k-th score stay for the sort by id
                cut = np.partition(scores[i, at], len(at) - self.k)[len(at) - self.k]
                at = at[scores[i, at] >= cut]
            q = int(who[i])
            mine = self.found.get(q, []) + list(zip((-scores[i, at]).tolist(), ids[start + at].tolist(), rows[start + at].tolist()))
            mine = self.found[q] = sorted(mine)[: self.k]
            if len(mine) == self.k:
                self.tau[q] = max(self.tau[q], float(-mine[-1][0]))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_block(pages: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """queries(row, vec_id, x, tau), at most about BLOCK_QUERIES -> the best k rows of each partition of pages for each."""
    asked = queries.toPandas()
    shared = pages.sparkSession.sparkContext.broadcast(
        (asked["row"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64), _small(_stack(asked["x"], dim)), asked["tau"].to_numpy(np.float64))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, ids, xs, tau = shared.value
        search = Search(rows, xs.astype(np.float64), tau, k)
        for pdf in batches:
            if len(pdf):
                search.visit(pdf, dim)
        out = [(rows[q], ids[q], row, vec_id, -minus) for q, mine in search.found.items() for minus, vec_id, row in mine]
        if out:
            yield pd.DataFrame(out, columns=["q_row", "query_id", "row", "vec_id", "score"])

    return pages.select("path", "rows", "ids", "far", "xs", "kind").mapInPandas(scan, _FOUND)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", page_rows: int = PAGE_ROWS, fanout: int = FANOUT
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of each query with all other rows.

    Ties go to the smaller id. Components are quantised to floor(1024 x); vectors that are null or hold a null or
    non-finite component take no part; shorter vectors count as padded with zeros. A query leaves out its own row alone,
    so another row of the same id is a candidate. Null ids are candidates (after all others) but no queries. An empty table
    gives no rows.

    The search of a query starts with the k-th score that it has inside its own page. Then the pages are read once for each
    block of queries, blocks of bounded size being broadcast one after another; each task searches the part of the tree
    above its pages best first. Nothing else is broadcast but the first level's sample of at most ``fanout`` vectors.
    """
    spark = vectors.sparkSession
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    raw = vectors.select(ids.alias("vec_id"), quantised(F.col(vector_col)).alias("x"), is_query.alias("asks"))
    raw = raw.withColumn("asks", F.coalesce("asks", F.lit(False)) & (F.col("vec_id") != NO_ID))
    rows = materialize(raw.where("x is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    pages = build_pages(rows, dim, k, page_rows, fanout)
    seeds = pages.select(F.inline("asking"))
    queries = materialize(rows.where("asks").join(seeds, "row").select("row", "vec_id", "x", "tau"), "queries")
    size = max(1, min(BLOCK_QUERIES, MAX_BROADCAST_BYTES // (8 * dim)))
    n_blocks = max(1, math.ceil(queries.count() / size))
    found = []
    with arrow_rows(spark, PAGES_A_BATCH):
        for block in range(n_blocks):
            mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block)
            found.append(materialize(_search_block(pages, mine, k, dim), "found"))
    release(rows, pages, queries)
    every = reduce(DataFrame.union, found)
    return _ranked(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for every hundredth."""
    return top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid AS qr, q.vec_id AS query_id, c.vec_id, c.rid, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, rid) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

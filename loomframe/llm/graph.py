"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import materialize, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)``, root being the smallest node of the component.

    Alternates large-star and small-star steps, each a grouped minimum and a join; every round ends in a table in the
    shared folder. Only the count and a checksum of the edges reach the driver. Self-loops are left out.
    """
    edges = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("v", "u"))
        first = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(
            both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            "large",
        )
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        fresh = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(edges, first, large, least)
        edges = fresh
        last, mark = mark, _mark(edges)
        if last == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())

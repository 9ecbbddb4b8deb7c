"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation and one join on the vertex, so a hub is split like any skewed join and nothing is
collected. Every step is staged, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node of each node's component, for all nodes with an edge to another node.

    Columns ``a`` and ``b`` are longs; edges may repeat, in either direction. No edges give no rows.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    cur = stage(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "cc-edges")
    before = None
    while (now := _mark(cur)) != before:
        before = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u hang on u's least neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "cc-large")
        # small star: neighbours below u, and u, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
    roots = cur.select(F.col("v").alias("u"), "v")
    return cur.unionByName(roots).distinct().select(F.col("u").alias("node"), F.col("v").alias("label"))

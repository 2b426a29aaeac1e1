"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablescope.sources.shared import cut_lineage


def _stars(edges: DataFrame) -> DataFrame:
    """Each ``u, v`` becomes ``v, m`` and each ``u`` its ``u, m``, with ``m`` the least of ``u`` and its neighbours."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _round(edges: DataFrame) -> DataFrame:
    """A large-star step, towards the least neighbour of all, and a small-star step, among the lesser ones."""
    mirrored = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = mirrored.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = mirrored.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _stars(large.distinct()).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): root is the least node it is connected to.

    Each step joins the edges with one row per node and combines minima inside the map tasks. A round is one job and is
    written to the shared folder; what it wrote is counted on the way, and the rounds end when nothing changes.
    Loops, repeated and reversed links are allowed; an empty table gives an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        seen = Observation()
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
        edges = cut_lineage(_round(edges).observe(seen, F.count(F.lit(1)).alias("edges"), digest), "component-edges")
        if seen.get == before:
            break
        before = seen.get
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, join_counted, staged


def _lowest(edges: DataFrame, name: str) -> DataFrame:
    """(u, m, times): the smallest v of every u, and how many edges it has; written down, as it is read twice."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")), name)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every end of links(a, b): root is the smallest node reachable. Nulls and loops are ignored.

    Every round joins the edge list twice with its minima by node, written to the shared folder. Minima are partial
    aggregates, and hubs with more than a thousandth of the edges are broadcast with theirs, so neither gathers the
    neighbourhood of a hub in one task.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "minima")
        large = staged(join_counted(both.where("v > u"), low, "u", "times").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        dropped(low)
        low = _lowest(large, "minima")
        met = join_counted(large, low, "u", "times").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = staged(met.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(edges), dropped(large), dropped(low)
        edges = small
        mark = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark

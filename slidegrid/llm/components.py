"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join with it; the minima are written first, so both
sides of the join are plain exchanges and adaptive execution can split a hub with very many links. Links are rewritten
in the shared folder every round, so the lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.shared import discard, release, stash


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other that points to none: then nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in_"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("out").alias("out"), F.max("in_").alias("in_"))
    return ends.where("out > 1 or (out = 1 and in_ = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """links (u, v), of any direction; null or equal ends are ignored. Returns (node, component): each node that has a
    link, with the smallest node that it reaches. An empty table gives no rows."""
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = stash(ordered, "links")
    while not _is_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = stash(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        down = stash(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        joined = large.join(down, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        following = stash(small.distinct(), "links")
        discard(least, large, down, edges)
        edges = following
        release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())

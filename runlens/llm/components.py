"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two shuffles of the edges; a hub's join is split by Spark when it is skewed. Each step's edges are a stored table, so
a lost executor costs one step, and the loop ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import stored


def _star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hu"), F.least("hu", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("hu")).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    return star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        star.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (u, v: long) that is not the smallest of its component."""
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "edges", edges.count())
    seen = None
    while True:
        rows = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (rows["n"], rows["h"])
        if state == seen or not rows["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        now = stored(small_star(large_star(now).distinct()).distinct(), "edges", state[0])

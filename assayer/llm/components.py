"""Connected components as joins: alternating large-star and small-star.

Each round replaces edges by edges to smaller neighbours until only stars
remain (R. Kiveris et al., *Connected components in MapReduce and beyond*).
A node's minimum is a partial aggregate and the join back can split a hot
node's rows, so a hub doesn't meet in one task. Every round is written to the
shared folder; neither edges nor labels reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node that an edge (a < b) names."""
    now, before = materialize(edges.where("a < b"), "stars"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        after = materialize(_small_star(_large_star(now)), "stars")
        discard(now)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )

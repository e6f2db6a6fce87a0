"""Connected components of a link table, by alternating stars (large star, small star).

Every round points each node at the smallest node it knows of; rounds end when no link changes.
Minima are combined before the shuffle, no node's links are ever gathered, and the state after each
round is a table in the shared folder, so the plan stays short and a lost executor costs a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root): every linked node and the smallest one it reaches."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
        edges = stored(small_star(large_star(edges)), "links")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point at the smallest node next to it, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, point at the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

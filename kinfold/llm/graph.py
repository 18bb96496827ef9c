"""Connected components by alternating large and small stars, every round written to shared storage.

Edges and components stay distributed; the driver sees whether one is left that isn't a star.  A vertex with very many
neighbours is aggregated before the shuffle, and its join is one that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b.  Each vertex hands its smallest neighbour to the others."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = around.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of each vertex of the undirected ``edges`` (a, b); the root is the smallest vertex."""
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        then, now = now, scratch.write(_star(_star(now, True), False))
        scratch.drop(then)
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("out")), F.struct(F.col("b").alias("v"), F.lit(0).alias("out")))).alias("e"))
        ends = ends.groupBy("e.v").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least"))
        if ends.where("out > 1 or out = 1 and least = 0").isEmpty():  # each vertex has one edge, to a root that has none
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

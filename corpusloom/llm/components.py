"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = near.where("b > a").select("a", F.col("b").alias("v")) if large else near.select("a", F.col("b").alias("v"))
    moved = out.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads from a leaf, which has no other edge, to the root of its star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("x"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("n")).where("leaf >= 1 and n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node it reaches.

    edges: (a, b) longs, in any direction, repeats and loops allowed; an empty table gives an
    empty result. Rounds grow with the logarithm of the longest chain; edges that are stars
    already take none. Each round is written to the shared folder; only a flag reaches the driver.
    """
    now = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        before, now = now, stored(_stars(_stars(now, True), False), "edges")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's least node.

    Each round aggregates the least neighbour of each node before it is joined back, so that a node
    with very many neighbours is neither collected nor sorted in one task. Self-loops and repeats are
    ignored.
    """
    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: neighbours above u go to the least of all
        large = e.withColumnRenamed("v", "w").withColumnRenamed("u", "x").join(least, F.col("w") == F.col("u")).select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.cut(small)
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.forget(e)
        e = new
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state

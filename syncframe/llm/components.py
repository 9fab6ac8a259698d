"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncframe.llm.common import Workspace


def connected_components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Large-star and small-star steps in turn: each node's neighbours move to the smallest node next to
    it, until the links are stars.  A step takes minima by partial aggregation and one join; links are
    written after each round, so a round's lineage starts at a table."""
    edges = work.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.save(large, f"{name}-large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = work.save(small.where("u <> v").distinct(), f"{name}-{step + 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{step}", f"{name}-large-{step}")
        step += 1
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

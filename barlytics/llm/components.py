"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm.tables import drop, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (u, v) other than the roots themselves.

    A root is the smallest node of its component. Each round writes the links to the
    shared folder, which cuts the lineage, and deletes those of the round before; the rounds grow with the logarithm of the
    longest path. Neighbours are never gathered, only their minimum.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(first, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "links")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(edges, first, large, low)
        edges = new

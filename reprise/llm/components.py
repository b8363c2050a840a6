"""Connected components of a link table by alternating star contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reprise.llm.common import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has a link.

    ``links`` has long columns a, b. Each round hangs every node's larger neighbours, and then its smaller ones, on the
    smallest node of its neighbourhood; link tables never grow beyond their input, and a node with very many neighbours
    is only aggregated (pre-combined before the shuffle) and joined. Rounds grow with the logarithm of the longest chain.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m")).withColumnRenamed("hi", "node")
        large = both.join(low, both["hi"] == low["node"]).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        low2 = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "node")
        small = large.join(low2, large["hi"] == low2["node"])
        edges = staged(small.select("hi", F.col("m").alias("lo")).union(small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct())
        # links keep what hangs together: once every node hangs on one other that hangs on none, these are the components
        ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

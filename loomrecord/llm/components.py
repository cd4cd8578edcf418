"""Connected components of an edge table, by hooking roots and shortening paths on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecord.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node of its component.

    Each round every root with a smaller neighbouring root hooks to the smallest such;
    the forest is then flattened by doubling, and edges are rewritten to roots. Roots at
    least halve, so rounds grow with the logarithm of the longest chain. Null ends and
    loops are ignored. Only counts reach the driver.
    """
    live = written(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = written(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not live.isEmpty():
        parent = written(live.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "parent")
        while True:  # double until every parent is a root
            up = parent.select(F.col("node").alias("p"), F.col("root").alias("pp"))
            step = written(parent.join(up, parent["root"] == up["p"], "left").select("node", F.coalesce("pp", "root").alias("root"), F.col("pp").isNotNull().alias("moved")), "parent")
            parent = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        new = parent.select(F.col("node").alias("p"), F.col("root").alias("new"))
        labels = written(labels.join(new, labels["root"] == new["p"], "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        a = live.join(new, live["u"] == new["p"], "left").select(F.coalesce("new", "u").alias("u"), "v")
        b = a.join(new, a["v"] == new["p"], "left").select("u", F.coalesce("new", "v").alias("v"))
        live = written(b.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return labels

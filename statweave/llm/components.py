"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statweave.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that can be reached.

    Every round a node takes the least label around it and then its label's label; each round is a written table, so the lineage stays short. A node with
    very many edges sums up in the tasks that hold them."""
    both = cut(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = cut(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        target = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = cut(lower.join(target, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        labels = after.select("node", "component")
        if after.filter("component <> old").isEmpty():
            return labels

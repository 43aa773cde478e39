"""Connected components of a graph of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import stage_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by one of its nodes.

    Each round maps a node to its smallest neighbour or itself and contracts the graph accordingly. Names should be
    hashes: then a round removes a fixed share of the nodes, whatever the graph, and few rounds are needed.
    """
    edges = stage_table(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        to = stage_table(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "link-labels")
        labels = to.withColumnRenamed("to", "component") if labels is None else stage_table(
            labels.join(to, F.col("component") == to["node"], "left").select(labels["node"], F.coalesce("to", "component").alias("component")), "labels")
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = stage_table(edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)

"""Connected components of a table of links, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved


def _neighbours(edges: DataFrame) -> DataFrame:
    """(node, m, downs, ups): each node's smallest neighbour or itself, and whether more than one is smaller, any larger.

    All are partial aggregates, so a node with very many neighbours is not gathered.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    both = edges.select(ends.alias("e")).select("e.*")
    smaller = F.col("other") < F.col("node")
    each = both.groupBy("node").agg(F.min("other").alias("m"), F.count(F.when(smaller, 1)).alias("downs"), F.count(F.when(~smaller, 1)).alias("ups"))
    return each.withColumn("m", F.least("m", "node"))


def components(links: DataFrame, a: str, b: str, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link.

    Alternates large-star and small-star rounds until each node is linked to its smallest alone; their number
    grows with the logarithm of the longest chain. Links are kept as (larger end ``a``, smaller end ``b``).
    A round's tables are written to the shared folder, which cuts lineage; one truth value a round comes to the
    driver. Nodes are broadcast where there are ``broadcast_nodes`` of them at most, and joined beyond. Links to
    itself or null do not count, repeated ones count once, and no links give no rows.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        near = saved(_neighbours(edges), "neighbours")
        # Stars already: no node has two centres, and no centre has one.
        if near.where("downs > 1 or downs > 0 and ups > 0").isEmpty():
            break
        # Large star: the larger end of a link goes to the smallest that the smaller end knows.
        few = near.limit(broadcast_nodes + 1).count() <= broadcast_nodes
        sent = F.broadcast if few else lambda df: df
        large = edges.join(sent(near.select(F.col("node").alias("b"), "m")), "b").select("a", F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = large.join(sent(lowest), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = saved(ends.where("a != b").distinct(), "star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())

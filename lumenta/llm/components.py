"""Connected components by alternating large-star and small-star rounds, each cut off durably."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import durable


#: Nodes whose least neighbours are broadcast; with more they are written, so that the join reads two plain shuffles and a node
#: with very many neighbours can be split.
FEW = 1 << 18


def _stars(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star round over (u, v) with u > v: each node's (large or small) neighbours are linked to its least neighbour or itself."""
    own = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = own.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = F.broadcast(least) if few else durable(least)
    linked = own.join(least, "u")
    if large:
        linked = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (u, v); nodes without an edge to another are left out."""
    at = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # done when every edge leads to a root: no node is both a child and a parent, and each child has one parent
        now = at.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if now == before or not now.n:
            break
        before = now
        at = durable(_stars(_stars(at, True, 2 * now.n <= FEW), False, 2 * now.n <= FEW))
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of graphs that are tables of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.places import checkpointed

#: Rounds after which something must be wrong: a round at least halves the longest way to a smaller node.
MOST_ROUNDS = 100


def _smallest(links: DataFrame, by: list[str]) -> DataFrame:
    """The links (u, v) with the smallest of u and its neighbours as m."""
    least = links.groupBy(*by, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least, [*by, "u"])


def large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    back = edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))
    return _smallest(edges.unionByName(back), by).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _smallest(down, by)
    others = starred.where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(starred.select(*by, "u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, by: list[str], node: str = "node", root: str = "root") -> DataFrame:
    """(by, node, root) of every node of the edges (by, u, v): the smallest node that can be reached within its group.

    Edges go both ways, may repeat and may have equal ends; edges with a null end link nothing. Each round is two aggregations and
    two joins by node, and its edges are checkpointed; when a round changes nothing, every node is linked to its root.
    """
    nodes = edges.select(*by, F.col("u").alias(node)).unionByName(edges.select(*by, F.col("v").alias(node))).where(F.col(node).isNotNull()).distinct()
    now = checkpointed(edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
    before = sign(now)
    for _ in range(MOST_ROUNDS):
        now = checkpointed(small_star(large_star(now, by), by))
        after = sign(now)
        if after == before:
            found = now.select(*by, F.col("u").alias(node), F.col("v").alias("_root"))
            return nodes.join(found, [*by, node], "left").select(*by, node, F.coalesce("_root", node).alias(root))
        before = after
    raise RuntimeError("components have not converged")

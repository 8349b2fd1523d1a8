"""Connected components of a table of links, by alternating large-star and small-star rounds.

No round gathers a component: each is a minimum per node (folded before it is moved) and a join back on the node. The
links of a hub are rows of 40 bytes; where they outgrow a task, the adaptive skew join splits them. Rounds are cut by reliable checkpoints. Chains shrink by a constant factor a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node of its component.

    Raises an error if the last of the rounds still changed something, as roots may not be final then.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = checkpointed(links.select(u, v).where("u <> v").distinct())
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node points down after the large one, so its neighbours are its smaller ones.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        edges = checkpointed(small.where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

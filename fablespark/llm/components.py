"""Connected components by alternating large-star and small-star steps.

Kiveris et al. (2014), "Connected components in MapReduce and beyond". Nothing
is gathered on the driver but one count and one checksum a round; a round's
edges go through reliable checkpoints. Every step groups by node with partial
aggregation and joins the node's minimum back, so that the heavy centre of a
star can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.llm.common import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    # Repeated links are merged by the small star that follows.
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u long, v long) that is no root itself.

    The root is the least node of the component. Edges may repeat and come in
    either direction; loops and edges with a null end are left out. An empty
    input gives an empty result.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        now = checkpointed(_small_star(_large_star(now)))
        after = state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

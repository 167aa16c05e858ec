"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.shared import materialize


def _with_least(edges: DataFrame, n_edges: int, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``least``'s m of their u (columns u, m, n: the number of u's edges).

    Nodes of more than ``heavy`` edges are broadcast; by their definition there are under 100,000 of them, whatever the data. The edges of any
    other node fit in a task, so that the shuffle on u has no hot key.
    """
    heavy = max(256, n_edges // 100_000)
    hubs = F.broadcast(least.where(F.col("n") > heavy).select("u", "m"))
    light = edges.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= heavy).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(light)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) to (node, component), the component's smallest node, by alternating large-star and small-star steps.

    Nodes of no edge and loops are left out. It ends when every tree is a star. Each round is written to the shared folder. The least neighbour of a node
    comes from a partially aggregated minimum and is joined back, hubs' by broadcast, so a hub is never gathered in one task.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    one = F.count(F.lit(1))
    for k in range(max_rounds):
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").count():
            break
        n = links.count()
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), one.alias("n")), f"least_{k}")
        large = _with_least(both.where("v > u"), 2 * n, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, f"large_{k}")
        small = _with_least(large, n, large.groupBy("u").agg(F.min("v").alias("m"), one.alias("n")))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = materialize(small, f"links_{k}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

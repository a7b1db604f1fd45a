"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them. Edges run from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge in `edges` (u, v); component is its least node.

    Self-loops, repeated edges and either direction are fine; edges with a null end are
    left out; no edges give no rows. Both steps only take minima per node and join them
    back, so a hub's neighbours are never gathered. Each round is written to the shared
    folder. The steps end when a round changes nothing.
    """
    current = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, seen = materialize(current, "cc"), None  # of the rounds, only the last stays on disk
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
        if mark[0] == 0:
            break
        last, current = current, materialize(_small_star(_large_star(current)), "cc")
        release(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Every edge now runs from a node to the least node of its component.
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of a graph by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace


def components(edges: DataFrame, workspace: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b), both long; component: the smallest node that it reaches.

    A large-star step links each node's larger neighbours to its smallest neighbour, a small-star step links its
    smaller neighbours and itself to that. Minima are combined before the shuffle; the join that follows has plain
    exchanges on both sides, so that adaptive execution splits a hot node. Each step is written to the shared folder.
    """
    now = workspace.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    for n in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = workspace.table(large, f"large-{n}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        then = workspace.table(small, f"edges-{n}")
        # Both steps keep the components, so it is done when neither changes the edges.
        size, total = _digest(then), _digest(now)
        workspace.drop(f"large-{n}")
        workspace.drop(f"edges-{n - 1}")
        now = then
        if size == total:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

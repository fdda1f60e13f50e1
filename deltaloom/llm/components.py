"""Connected components by alternating large and small stars.

Every round is two aggregations and two joins on the node; no neighbourhood is
collected, so a hub with a third of all edges is summed map-side and its join
is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written out: the joins below then read two plain exchanges each, and a hub's rows can be split
    least = materialize(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m")))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = materialize(down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")))
    near = down.join(least, F.col("u") == F.col("c"))
    return (
        near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any ordered type -> ``(node, root)``, root the least node.

    Only nodes that have an edge to another node appear. An empty table gives
    an empty table; loops, repeated and reversed edges and nulls do no harm.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now).distinct()).distinct())
        release(before)
        # the edges have settled once each node points at its root and no node is both child and parent
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

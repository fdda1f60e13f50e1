"""Bounded reachability and components over edge tables.

Each hop is one join and one minimum; the frontier holds only what improved.
The tables are cut in the shared folder after each hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, release


#: hops after which the tables of what has been seen are written as one
COMPACT = 16


def _walk(step: DataFrame, sources: DataFrame, max_hops: int | None) -> DataFrame:
    """``step(way, node, next, cost)``, ``sources(entry, node, way)`` -> ``(entry, way, node, distance)``, the least for each.

    All hops of one way cost the same, so what is met first is nearest. Each
    hop writes what is new and nothing else; a node that was seen is left out by an anti-join.
    """
    keys = ["entry", "way", "node"]
    frontier = materialize(sources.select(*keys, F.lit(0).cast("long").alias("distance")).distinct())
    seen, written, hops = frontier, [frontier], 0
    while max_hops is None or hops < max_hops:
        hops += 1
        reached = frontier.join(step, ["way", "node"]).select("entry", "way", F.col("next").alias("node"),
            (F.col("distance") + F.col("cost")).alias("distance")).distinct()
        frontier = materialize(reached.join(seen.select(*keys), keys, "left_anti"))
        if frontier.isEmpty():
            break
        written.append(frontier)
        seen = seen.unionByName(frontier)
        if len(written) == COMPACT:
            seen = materialize(seen)
            # the frontier is still read in the next hop
            release(*written[:-1])
            written = [seen]
    return seen


def distances(edges: DataFrame, sources: DataFrame, cost: int = 1, reverse: bool = False, max_hops: int | None = None) -> DataFrame:
    """``sources(entry, node)``, ``edges(src, dst)`` -> least ``(entry, node, distance)``; a hop costs ``cost``."""
    step = edges.select(F.lit(0).alias("way"), F.col("dst" if reverse else "src").alias("node"), F.col("src" if reverse else "dst").alias("next"),
        F.lit(cost).cast("long").alias("cost")).distinct()
    return _walk(materialize(step), sources.withColumn("way", F.lit(0)), max_hops).drop("way")


def reachability(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Forward hops cost one, backward hops two; one path goes in one direction; the least counts.

    Both ways are walked in one loop.
    """
    one = lambda way, a, b: edges.select(F.lit(way).alias("way"), F.col(a).alias("node"), F.col(b).alias("next"), F.lit(way + 1).cast("long").alias("cost"))
    step = materialize(one(0, "src", "dst").unionByName(one(1, "dst", "src")).distinct())
    both = _walk(step, sources.select("entry", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("way")), max_hops)
    return both.groupBy("entry", "node").agg(F.min("distance").alias("distance"))


def call_chain(edges: DataFrame, sources: DataFrame, max_depth: int = 10) -> DataFrame:
    """What the sources reach over Calls edges in at most ``max_depth`` hops, without the sources themselves.

    All parallel edges between two symbols are looked at.
    """
    return distances(edges.where("edge_type = 'Calls'"), sources, max_hops=max_depth).where("distance > 0")


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` of undirected edges, the least node of each; single nodes included.

    Labels spread to neighbours and are then shortened by one pointer jump a round.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    label = materialize(nodes.select("node", F.col("node").alias("component")).distinct())
    mark = None
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        low = materialize(low)
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = materialize(low.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        new = label.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if new == mark:
            return label
        mark = new
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and an equi-join on the node, so a hub is pre-aggregated on one side and
may be split by adaptive execution on the other; lineage is cut by a checkpoint after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folium.session import settled

#: Nodes of a side (16 bytes each) that is broadcast; larger ones are joined by shuffle.
BROADCAST_NODES = 1_000_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (64-bit nodes) -> ``node, root``: the least node reachable, for nodes on some edge.

    Loops, repeated and reversed edges are allowed; edges with a null end are ignored.
    """
    state = settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = _signature(state)
    while known[0]:
        # Both sides have a row per node at most, and every edge has two nodes.
        side = F.broadcast if 2 * known[0] <= BROADCAST_NODES else (lambda x: x)
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = side(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = side(large.groupBy("b").agg(F.min("a").alias("m")))
        small = (
            large.join(down, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        state = settled(small)
        now = _signature(state)
        if now == known:
            break
        known = now
    roots = state.select(F.col("b").alias("node"), F.col("a").alias("root"))
    rooted = roots.unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node")
    return settled(rooted.agg(F.min("root").alias("root")))


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` after more edges: their components are found between the roots alone."""
    ends = edges.select(F.struct("a", "b").alias("e"), F.explode(F.array("a", "b")).alias("x"))
    rooted = ends.join(roots, F.col("x") == F.col("node"), "left").select("e", F.coalesce("root", "x").alias("r"))
    lifted = settled(rooted.groupBy("e").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("a", "b").distinct())
    if lifted.isEmpty():
        return roots
    upper = components(lifted).select(F.col("node").alias("old"), F.col("root").alias("top"))
    small = F.broadcast(upper) if upper.count() <= BROADCAST_NODES else upper
    moved = roots.join(small, F.col("root") == F.col("old"), "left").select("node", F.coalesce("top", "root").alias("root"))
    # Nodes that no edge had touched before are roots of their own.
    fresh = upper.join(roots.select("node"), F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("top").alias("root"))
    return settled(moved.unionByName(fresh))

"""Connected components by edge contraction, entirely in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrydeck.session import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node id reachable) for each node that an edge names.

    Every round each node points to the neighbour (or itself) whose hashed id is smallest,
    and the edges are contracted along these pointers. Hashed ids make the number of nodes
    fall geometrically, on chains too, so that the rounds are logarithmic. Each round's
    pointers are checkpointed; only the number of remaining edges reaches the driver.
    Self loops count as nodes without partners; null ends are ignored.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    first = cut(pairs.distinct())
    levels = []
    now = first.where("u <> v")
    while not now.isEmpty():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v")))
        points = both.groupBy("u").agg(least.alias("m")).select("u", F.least(F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v")), "m").getField("v").alias("to"))
        points = cut(points)
        levels.append(points)
        moved = now.join(points, "u").select(F.col("to").alias("a"), F.col("v").alias("u")).join(points, "u").select("a", F.col("to").alias("b"))
        now = cut(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    root = None
    for points in reversed(levels):
        if root is None:
            root = points.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            up = root.select(F.col("node").alias("to"), "root")
            root = points.join(up, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
    alone = first.where("u = v").select(F.col("u").alias("node"))
    if root is None:
        return alone.distinct().select("node", F.col("node").alias("component"))
    names = root.groupBy("root").agg(F.min("node").alias("component"))
    linked = root.join(names, "root").select("node", "component")
    return linked.union(alone.join(linked, "node", "left_anti").distinct().select("node", F.col("node").alias("component")))

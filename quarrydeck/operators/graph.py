"""Dependency graphs: transitive dependents and package dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrydeck.session import cut

from .components import components

__all__ = ["closure", "components", "package_deps", "transitive_scores"]


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 64) -> DataFrame:
    """src, dst: every pair that one or more edges connect, without a node's way back to itself.

    The paths double in length each round, so a chain of n edges takes log n rounds; cycles end
    because only new pairs go on. Each round's pairs are checkpointed.
    """
    step = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct())
    seen = step
    for _ in range(rounds):
        longer = seen.select("src", F.col("dst").alias("mid")).join(seen.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").where("src <> dst").distinct()
        new = cut(longer.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.union(new))
    raise RuntimeError(f"paths go on after {rounds} rounds of doubling")


def transitive_scores(edges: DataFrame, each: int = 5, cap: int = 50) -> DataFrame:
    """key, dependents, score: how many keys depend on each, directly or not. edges: src depends on dst."""
    n = closure(edges).groupBy(F.col("dst").alias("key")).agg(F.countDistinct("src").alias("dependents"))
    return n.withColumn("score", F.least(F.col("dependents") * each, F.lit(cap)).cast("long"))


def package_deps(edges: DataFrame) -> DataFrame:
    """package, deps: the sorted internal packages that each one depends on, joined by commas. edges: src, dst."""
    own = edges.where("src <> dst").select("src", "dst").distinct()
    return own.groupBy(F.col("src").alias("package")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("deps"), F.count(F.lit(1)).alias("n_deps"))

"""Connected components of a link table by contraction rounds; no links or labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """id and component (least id reachable) of every id in links (a, b: long; order and repeats don't matter).

    In each round every node hooks to its neighbour of least random rank, if that is below its own; links move to the
    nodes hooked to, loops and repeats go. The rounds are logarithmic in the longest chain, expectedly; each ends in a
    table in the shared folder that replaces that of the round before. An empty table gives none.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    root = None
    rounds = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rounds)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(rank("b")).alias("n")).select(F.col("a").alias("v"), F.least(F.col("n"), rank("a"))["v"].alias("up"))
        hooks = materialize(hooks)
        if root is None:
            new = hooks.select(F.col("v").alias("id"), F.col("up").alias("root"))
        else:
            new = root.join(hooks, F.col("root") == F.col("v"), "left").select("id", F.coalesce("up", "root").alias("root"))
        new = materialize(new)
        moved = edges.join(hooks.select(F.col("v").alias("a"), F.col("up").alias("x")), "a").join(hooks.select(F.col("v").alias("b"), F.col("up").alias("y")), "b")
        left = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(edges, hooks, root)
        edges, root = left, new
        rounds += 1
    if root is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    release(edges)
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")

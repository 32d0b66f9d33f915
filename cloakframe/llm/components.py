"""Connected components of edge tables: labels spread by joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the component is its smallest node.

    Large-star, small-star: every round links the larger neighbours of a node, then its smaller ones, to the smallest
    of them, until each node hangs on its component's smallest node. Rows never exceed the edges; all is distributed.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").select("a", F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).otherwise(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y"))))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct()
        new = written(small, "edges")
        # stars: nothing that is linked to is itself linked on
        linked_on = new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").limit(1)
        doubly = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        done = linked_on.isEmpty() and doubly.isEmpty()
        removed(now)
        now = new
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

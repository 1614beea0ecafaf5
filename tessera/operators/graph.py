"""Distributed graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, removed, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of an undirected edge list; a component is its smallest node.

    Edges point from the larger to the smaller node, and each round is a large-star step (``a -> b``
    becomes ``a`` -> smallest neighbour of ``b``) and a small-star step (all smaller neighbours of a
    node go to the smallest of them); it ends when every edge points to a root. The minima are combined
    before the shuffle and written as tables of one row a node. Both sides of each join are such
    tables, so Spark broadcasts the minima where they are small by its own setting, and otherwise
    adaptive execution can split the partition of a hub, whose neighbours thus need not meet in one
    task. Rounds grow with the logarithm of the longest path; their tables are removed when the next
    ones stand. Null ends and loops are ignored; an empty list gives an empty result. Nothing but two
    flags of each round reaches the driver.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)[src]
    e = edges.select(F.col(src).cast(kind).alias("x"), F.col(dst).cast(kind).alias("y"))
    e = e.where("x is not null and y is not null and x <> y")
    e, path = stored(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    for _ in range(max_rounds):
        low, low_path = stored(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        up = low.select(F.col("a").alias("v"), F.col("m").alias("to"))
        large, large_path = stored(e.join(up, F.col("b") == F.col("v"), "left").select("a", F.coalesce("to", "b").alias("b"), F.col("to").isNotNull().alias("moved")))
        done = large.where("moved").isEmpty() and low.where("n > 1").isEmpty()
        removed(spark, low_path)
        if done:
            removed(spark, large_path)
            break
        low, low_path = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low.withColumnRenamed("a", "v"), F.col("a") == F.col("v")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = path
        e, path = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        for p in (before, large_path, low_path):
            removed(spark, p)
    else:
        raise RuntimeError("connected_components: no fixed point within max_rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = durable(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    removed(spark, path)
    return out

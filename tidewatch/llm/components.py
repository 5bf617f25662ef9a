"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. links: two columns of one orderable type.

    Each round hangs every node's larger neighbours, then its smaller ones, on its least neighbour; rounds grow with
    the logarithm of the longest path. Links stay distributed: a round's minima are taken before the shuffle, the
    join back is one that adaptive execution can split, and two numbers a round reach the driver.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.col("c"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialize(small.union(least.select("c", "m")).distinct(), "stars")
        discard(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())

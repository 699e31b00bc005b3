"""Connected components by alternating large-star and small-star steps, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """(x, y, m) for each pair: m is the least of x and all its neighbours. Minima are summed map-side before the shuffle."""
    low = pairs.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
    return pairs.join(low, F.col("x") == F.col("k")).drop("k")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    The loop ends when a round changes nothing; rounds grow with the logarithm of the longest path. Nothing but the
    number of edges and a sum over them reaches the driver.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        large = _least(both).filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.col("u").alias("x"), F.col("v").alias("y"))
        small = _least(down)
        small = small.select(F.col("y").alias("u"), F.col("m").alias("v")).union(small.select(F.col("x").alias("u"), F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "edges")
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

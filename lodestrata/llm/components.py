"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node) for each node that has an edge.

    Edges never come to the driver; each round is written to the shared folder.
    It ends when every component is a star, that is when no node has two lower
    neighbours or is at both ends of edges; the number of rounds grows with the logarithm of the largest
    component.  A node's neighbours aren't gathered: their minimum is an
    aggregate, which is joined back.
    """
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        )
        e = materialize(small, "small")
        twice = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        inner = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").select("u")
        if twice.unionByName(inner).isEmpty():
            break
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Graphs as tables of edges: degrees, components, PageRank, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import cut


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``node, in_degree, out_degree, degree, weight``: parallel edges count each, a loop counts twice."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), w.alias("w")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), w.alias("w")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"), F.count(F.lit(1)).alias("degree"), F.sum("x.w").alias("weight"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component`` (the smallest node reached): each node takes the least label around it, and the label of that label, until none changes."""
    pairs = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    everything = pairs.select(F.col("src").alias("node")).distinct()
    if nodes is not None:
        everything = everything.unionByName(nodes.select("node")).distinct()
    labels = cut(everything.withColumn("component", F.col("node")))
    while True:
        near = pairs.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("k"), F.col("component").alias("kc"))
        new = cut(step.join(jump, F.col("component") == F.col("k"), "left").select("node", F.least("component", "kc").alias("component"), "old"))
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, rounds: int = 200, weight: str | None = None) -> DataFrame:
    """``node, rank``: what nodes without out-edges hold is spread evenly; stops at a total change under ``tolerance``."""
    e = edges.groupBy("src", "dst").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("w"))
    e = cut(e.join(e.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = cut(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = e.select("src").distinct()
    ranks = cut(nodes.join(out, F.col("node") == F.col("src"), "left").select("node", F.col("src").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        lost = ranks.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = e.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        new = cut(ranks.join(got, F.col("node") == F.col("dst"), "left").select("node", "dangling", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")))
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if moved < tolerance:
            break
    return ranks.select("node", "rank")


def shortest_paths(edges: DataFrame, source: object, weight: str | None = None, meaning: str = "distance", directed: bool = True) -> DataFrame:
    """``node, distance`` from one node; with ``meaning='strength'`` an edge is 1 / weight long.  Of parallel edges the shortest counts."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", (1 / w if meaning == "strength" else w).alias("w"))
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    e = cut(e.groupBy("src", "dst").agg(F.min("w").alias("w")))
    known = cut(edges.select(F.col("src").alias("node")).filter(F.col("node") == source).limit(1).select("node", F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")))
    while True:
        step = known.filter("fresh").join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("d")).agg(F.min(F.col("distance") + F.col("w")).alias("try"))
        both = known.join(step, F.col("node") == F.col("d"), "full")
        better = F.col("try").isNotNull() & (F.col("distance").isNull() | (F.col("try") < F.col("distance")))
        known = cut(both.select(F.coalesce("node", "d").alias("node"), F.when(better, F.col("try")).otherwise(F.col("distance")).alias("distance"), better.alias("fresh")))
        if not known.filter("fresh").limit(1).count():
            return known.select("node", "distance")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Modularity of a partition ``node, community`` of an undirected graph."""
    e = edges.join(groups.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(groups.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    m = e.count()
    inner = e.filter("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.count(F.lit(1)).alias("i"))
    total = e.select(F.explode(F.array("cs", "cd")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    return total.join(inner, "c", "left").agg(F.sum(F.coalesce("i", F.lit(0)) / m - F.pow(F.col("d") / (2.0 * m), F.lit(2.0))).alias("modularity"))

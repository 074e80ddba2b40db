"""Ranks, running sums, shares: operators over ordered partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import Rejected, dtype, finite
from .running import cut, looking_back, running


def average_rank(df: DataFrame, column: str, output: str = "rank", groups: Sequence[str] = ()) -> DataFrame:
    """Ties get the mean of their ranks.  Counts of values are ranked, not rows, so a window sees each value once."""
    keys = [*groups, column]
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, [F.col(k) for k in keys], {"__upto": F.col("__n")})
    if groups:
        starts = cut(upto).groupBy(*groups).agg(F.min(F.col("__upto") - F.col("__n")).alias("__start"))
        same = [F.col(f"__g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(groups)]
        upto = upto.join(starts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__start"), reduce(and_, same)).drop(*[f"__g{i}" for i in range(len(groups))])
    start = F.col("__start") if groups else F.lit(0)
    ranks = upto.select(*keys, (F.col("__upto") - start - (F.col("__n") - 1) / 2.0).alias(output))
    return df.join(ranks, keys, "left")


def lag_features(df: DataFrame, value: str, order: str, lags: Sequence[int], window: int, groups: Sequence[str] = ()) -> DataFrame:
    """Lags, and the mean of the ``window`` rows strictly before (null until there are as many)."""

    def add(w: WindowSpec) -> dict[str, Column]:
        before = w.rowsBetween(-window, -1)
        mean = F.when(F.count(value).over(before) == window, F.avg(value).over(before))
        return {f"lag_{k}": F.lag(value, k).over(w) for k in lags} | {f"rolling_{window}": mean}

    return looking_back(df, [order], groups, max(window, *lags, 0), add)


def ecdf(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """``value, cumulative``: right-continuous, ties combined."""
    c = F.col(column)
    counts = df.filter(finite(c, dtype(df, column))).groupBy(c.alias("value")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("__w"))
    total = counts.agg(F.sum("__w")).first()[0] or 1.0
    return running(counts, [F.col("value")], {"__upto": F.col("__w")}).select("value", (F.col("__upto") / total).alias("cumulative"))


def pareto(df: DataFrame, category: str, amount: str | None = None) -> DataFrame:
    """``category, amount, cumulative_percent``, the largest first."""
    sums = df.groupBy(F.col(category).alias("category")).agg((F.sum(amount) if amount else F.count(F.lit(1))).cast("double").alias("amount"))
    sums = cut(sums)
    total = sums.agg(F.sum("amount")).first()[0]
    upto = running(sums, [F.col("amount").desc(), F.col("category")], {"__upto": F.col("amount")})
    return upto.select("category", "amount", (100 * F.col("__upto") / F.lit(total)).alias("cumulative_percent"))


def waterfall(df: DataFrame, order: str, kind: str, amount: str, tolerance: float = 1e-9) -> DataFrame:
    """Running total of changes from the start; the end must be what comes out."""
    out = running(df, [F.col(order)], {"total": F.when(F.col(kind) != "end", F.col(amount))})
    end = out.filter(F.col(kind) == "end").select(amount, "total").first()
    if end is not None and abs(end[0] - end[1]) > tolerance * max(1.0, abs(end[0])):
        raise Rejected(f"the end is {end[0]}, the sum {end[1]}")
    return out


def shares(df: DataFrame, x: str, series: str, amount: str) -> DataFrame:
    """``x, series, amount, bottom, top, percent``: stacked amounts of each x; totals must be over 0."""
    sums = df.groupBy(F.col(x).alias("x"), F.col(series).alias("series")).agg(F.sum(amount).cast("double").alias("amount"))
    if sums.groupBy("x").agg(F.sum("amount").alias("t")).filter("t <= 0").limit(1).count():
        raise Rejected("a total isn't over 0")
    w = Window.partitionBy("x").orderBy("series").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("amount").over(Window.partitionBy("x"))
    top = F.sum("amount").over(w)
    return sums.select("x", "series", "amount", (top - F.col("amount")).alias("bottom"), top.alias("top"), (100 * F.col("amount") / total).alias("percent"))


def top_values(df: DataFrame, column: str, ordinal: str, n: int = 20) -> DataFrame:
    """``value, count`` of the most frequent: by count, then first seen."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(ordinal).alias("__first"))
    return counts.orderBy(F.col("count").desc(), "__first").limit(n).select("value", "count")


def top_and_other(df: DataFrame, column: str, ordinal: str, n: int, other: str = "other") -> DataFrame:
    """Counts of the ``n`` most frequent values, and of all the rest together."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(ordinal).alias("__first"))
    kept = counts.orderBy(F.col("count").desc(), "__first").limit(n).select("value", "count", F.lit(0).alias("__rest"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    rest = total.join(kept.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("k"))).select(F.lit(other).alias("value"), (F.col("t") - F.col("k")).alias("count"), F.lit(1).alias("__rest"))
    return kept.unionByName(rest.filter("count > 0")).drop("__rest")


def systematic_sample(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    """Rows number floor(j * n / k) in the order of ``ordinal`` (gapless from 0)."""
    n = df.count()
    if n <= k:
        return df
    place = F.col(ordinal)
    j = F.ceil(place * k / n)
    return df.filter(F.floor(j * n / k) == place)

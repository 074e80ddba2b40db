"""Time series: regular grids, gaps, resampling, simple forecasts and their errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import Rejected
from .running import looking_back

UNITS = {"h": ("hour", "1 hour"), "D": ("day", "1 day"), "W-MON": ("week", "7 days"), "MS": ("month", "1 month")}


def resample(df: DataFrame, time: str, value: str, frequency: str, op: str = "mean", groups: Sequence[str] = ()) -> DataFrame:
    """``*groups, time, value``: periods closed on the left."""
    return df.groupBy(*groups, F.date_trunc(UNITS[frequency][0], time).alias("time")).agg({"sum": F.sum, "mean": F.avg}[op](value).alias("value"))


def gaps(df: DataFrame, time: str, frequency: str, groups: Sequence[str] = ()) -> DataFrame:
    """Periods of the grid from a group's first to its last that aren't there."""
    unit, step = UNITS[frequency]
    t = F.date_trunc(unit, time)
    have = df.select(*groups, t.alias("time")).distinct()
    grid = df.groupBy(*groups).agg(F.min(t).alias("a"), F.max(t).alias("b")).select(*groups, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("time"))
    return grid.join(have, [*groups, "time"], "left_anti")


def normalise(df: DataFrame, time: str, value: str, frequency: str, groups: Sequence[str] = ()) -> DataFrame:
    """The series on its grid; duplicates and gaps are refused."""
    t = F.date_trunc(UNITS[frequency][0], time)
    if df.groupBy(*groups, t.alias("t")).count().filter("count > 1").limit(1).count():
        raise Rejected("two values for a period")
    if gaps(df, time, frequency, groups).limit(1).count():
        raise Rejected("a period is missing")
    return df.select(*groups, t.alias("time"), F.col(value).alias("value"))


def seasonal_naive(df: DataFrame, time: str, value: str, period: int, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``naive`` (the row before) and ``seasonal`` (the row a period before)."""
    return looking_back(df, [time], groups, max(1, period), lambda w: {"naive": F.lag(value, 1).over(w), "seasonal": F.lag(value, period).over(w)})


def forecast_errors(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    e = F.col(actual) - F.col(forecast)
    return df.filter(e.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.lit(1.0) - F.sum(e * e) / (F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"))


def acf(df: DataFrame, time: str, value: str, lags: int, groups: Sequence[str] = ()) -> DataFrame:
    """``lag, acf``: products of centred values over the sum of squares."""
    means = df.groupBy(*groups).agg(F.avg(value).alias("__mean"))
    means = F.broadcast(means) if not groups else means.withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(groups)})
    same = reduce(and_, [F.col(f"__g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(groups)], F.lit(True))
    c = df.select(*groups, time, value).join(means, same).select(*groups, time, (F.col(value) - F.col("__mean")).alias("c"))
    products = looking_back(c, [time], groups, lags, lambda w: {f"p{k}": F.col("c") * F.lag("c", k).over(w) for k in range(1, lags + 1)})
    sums = products.groupBy(*groups).agg(*[(F.sum(f"p{k}") / F.sum(F.col("c") * F.col("c"))).alias(str(k)) for k in range(1, lags + 1)])
    return sums.unpivot(list(groups), [str(k) for k in range(1, lags + 1)], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def change_point(df: DataFrame, time: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """The split of each series into two levels that leaves the least squares: from running sums."""
    w = Window.partitionBy(*groups).orderBy(time)
    upto, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*groups)
    n, s = F.count(value).over(upto), F.sum(value).over(upto)
    total_n, total = F.count(value).over(all_), F.sum(value).over(all_)
    gain = s * s / n + F.when(total_n > n, (total - s) * (total - s) / (total_n - n))
    scored = df.select(*groups, F.lead(time).over(w).alias("change_at"), gain.alias("__gain"), (s / n).alias("before"), ((total - s) / F.nullif(total_n - n, F.lit(0).cast("bigint"))).alias("after")).filter("__gain is not null")
    return scored.groupBy(*groups).agg(F.max_by(F.struct("change_at", "before", "after"), "__gain").alias("x")).select(*groups, "x.*")


def smooth(df: DataFrame, time: str, value: str, alpha: float, groups: Sequence[str]) -> DataFrame:
    """Exponential smoothing, one step ahead; recursive, so each series (one group) is a pandas frame."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups, time).schema) + ", value double, forecast double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        level = pdf[value].astype(float).ewm(alpha=alpha, adjust=False).mean()
        out = pdf[[*groups, time]].copy()
        out["value"], out["forecast"] = pdf[value].astype(float), level.shift(1)
        return out

    return df.groupBy(*groups).applyInPandas(run, schema)


def croston(df: DataFrame, time: str, value: str, alpha: float, groups: Sequence[str]) -> DataFrame:
    """``*groups, demand, interval, forecast`` of intermittent demand."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema) + ", demand double, interval double, forecast double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        demand = interval = None
        since = 0
        for v in pdf[value].astype(float):
            since += 1
            if v > 0:
                demand = v if demand is None else demand + alpha * (v - demand)
                interval = float(since) if interval is None else interval + alpha * (since - interval)
                since = 0
        out = pdf[list(groups)].iloc[:1].copy()
        out["demand"], out["interval"] = demand, interval
        out["forecast"] = demand / interval if demand is not None else 0.0
        return out

    return df.groupBy(*groups).applyInPandas(run, schema)

"""Signals on regular grids: spectra, partial autocorrelation, scaled errors.

A frequency's sums are aggregates over the rows, so a series may be as long as a table; only lags and frequencies, which the caller names, are few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Rejected
from .running import looking_back
from .timeseries import acf

#: Windows by their cosine terms: a0 - a1 cos(2 pi i / n), periodic.
TAPERS = {"boxcar": (1.0, 0.0), "hann": (0.5, 0.5), "hamming": (0.54, 0.46)}


def periodogram(df: DataFrame, index: str, value: str, frequencies: Sequence[int], n: int, taper: str = "boxcar", groups: Sequence[str] = ()) -> DataFrame:
    """``*groups, k, power``: of ``n`` samples (``index`` from 0) the one-sided spectral density at ``k`` cycles over the series; missing samples count as 0."""
    if taper not in TAPERS or not frequencies or any(not 0 <= k <= n // 2 for k in frequencies):
        raise Rejected("taper or frequencies")
    a0, a1 = TAPERS[taper]
    i = F.col(index)
    w = F.lit(a0) - F.lit(a1) * F.cos(2 * math.pi * i / n)
    x = F.col(value).cast("double") * w
    parts = []
    for k in frequencies:
        turn = 2 * math.pi * F.pmod(i * k, F.lit(n)) / n
        parts += [F.sum(x * F.cos(turn)).alias(f"c{k}"), F.sum(x * F.sin(turn)).alias(f"s{k}")]
    energy = n * (a0 * a0 + a1 * a1 / 2)
    both = lambda k: 1.0 if k == 0 or 2 * k == n else 2.0
    sums = df.groupBy(*groups).agg(*parts)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), (both(k) * (F.col(f"c{k}") ** 2 + F.col(f"s{k}") ** 2) / energy).alias("power")) for k in frequencies])
    return sums.select(*groups, F.explode(cells).alias("x")).select(*groups, "x.*")


def welch(df: DataFrame, index: str, value: str, frequencies: Sequence[int], segment: int, taper: str = "hann") -> DataFrame:
    """``k, power``: the mean of the densities of half-overlapping whole segments, each less its mean."""
    half = segment // 2
    if half < 1 or segment % 2:
        raise Rejected("a segment has an even number of samples")
    i = F.col(index)
    part = F.explode(F.array(F.floor(i / half), F.floor(i / half) - 1)).alias("segment")
    rows = df.select(i.alias("i"), F.col(value).cast("double").alias("v"), part).filter("segment >= 0").withColumn("i", F.col("i") - F.col("segment") * half)
    means = rows.groupBy("segment").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == segment)
    centred = rows.join(means, "segment").withColumn("v", F.col("v") - F.col("m"))
    return periodogram(centred, "i", "v", frequencies, segment, taper, ["segment"]).groupBy("k").agg(F.avg("power").alias("power"))


def pacf(df: DataFrame, time: str, value: str, lags: int) -> DataFrame:
    """``lag, pacf`` by Durbin and Levinson's recursion from the autocorrelations."""
    r = [1.0, *[x[0] for x in acf(df, time, value, lags).orderBy("lag").select("acf").collect()]]
    if any(x is None for x in r):
        raise Rejected("no spread, or too few values")
    phi, out = [], []
    for k in range(1, lags + 1):
        rest = 1 - sum(p * r[j + 1] for j, p in enumerate(phi))
        last = (r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))) / rest
        phi = [p - last * q for p, q in zip(phi, reversed(phi), strict=True)] + [last]
        out.append((k, float(last)))
    return df.sparkSession.createDataFrame(out, "lag int, pacf double")


def scaled_error(df: DataFrame, time: str, actual: str, forecast: str, period: int = 1, groups: Sequence[str] = ()) -> DataFrame:
    """``*groups, n, mase``: mean absolute error over that of the value a period before; null where that is 0."""
    rows = looking_back(df, [time], groups, period, lambda w: {"__naive": F.abs(F.col(actual) - F.lag(actual, period).over(w))})
    e = F.abs(F.col(actual) - F.col(forecast))
    return rows.groupBy(*groups).agg(F.count(e).alias("n"), F.try_divide(F.avg(e), F.avg("__naive")).alias("mase"))

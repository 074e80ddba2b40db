"""Survival beyond one curve: cumulative hazards, competing risks, proportional hazards, concordance.

Rows are reduced to sums for each distinct time, and what is summed along time is summed in ranges of its order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_sf2
from ..functions.values import Rejected, dtype, finite
from .glm import linear
from .running import cut, running


def nelson_aalen(df: DataFrame, duration: str, event: str, entry: str | None = None) -> DataFrame:
    """``time, at_risk, events, hazard, variance`` at times with events; with ``entry``, rows are at risk after it only.

    Rows without a duration or event, or that leave before they enter, are left out.
    """
    ok = df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull())
    if entry:
        ok = ok.filter(F.col(entry) < F.col(duration))
    # A row that enters at a time is at risk from after it: its entry counts to those that leave later.
    moves = ok.select(F.col(duration).alias("time"), F.col(event).cast("int").alias("d"), F.lit(1).alias("left"), F.lit(0).alias("came"))
    if entry:
        moves = moves.unionByName(ok.select(F.col(entry).alias("time"), F.lit(0).alias("d"), F.lit(0).alias("left"), F.lit(1).alias("came")))
    t = moves.groupBy("time").agg(F.sum("d").alias("events"), F.sum("left").alias("left"), F.sum("came").alias("came"))
    down = running(t, [F.col("time").desc()], {"gone": F.col("left"), "entered": F.col("came")})
    risk = down.select("time", "events", (F.col("gone") - F.col("entered")).alias("at_risk"))
    d, n = F.col("events"), F.col("at_risk")
    return running(risk.filter("events > 0"), [F.col("time")], {"hazard": d / n, "variance": d / (n * n)}).select("time", "at_risk", "events", "hazard", "variance")


def cumulative_incidence(df: DataFrame, duration: str, cause: str, causes: Sequence) -> DataFrame:
    """``time, cause, incidence``: by cause (null: censored) the share that has had it, other causes counted as leaving."""
    ok = df.filter(F.col(duration).isNotNull())
    t = ok.groupBy(F.col(duration).alias("time")).agg(F.count(F.lit(1)).alias("left"), F.count(cause).alias("d"), *[F.count(F.when(F.col(cause) == c, 1)).alias(f"d{i}") for i, c in enumerate(causes)])
    down = running(t, [F.col("time").desc()], {"n": F.col("left")}).filter("d > 0")
    d, n = F.col("d"), F.col("n")
    logs = running(down, [F.col("time")], {"__log": F.coalesce(F.log(F.when(d < n, 1 - d / n)), F.lit(0.0))})
    # Survival just before: what the time itself adds is taken off again; where all die, nobody is left after it anyway.
    before = F.exp(F.col("__log") - F.coalesce(F.log(F.when(d < n, 1 - d / n)), F.lit(0.0)))
    parts = logs.select("time", *[(before * F.col(f"d{i}") / n).alias(f"p{i}") for i in range(len(causes))])
    upto = running(parts, [F.col("time")], {f"c{i}": F.col(f"p{i}") for i in range(len(causes))})
    cells = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"c{i}").alias("incidence")) for i, c in enumerate(causes)])
    return upto.select("time", F.explode(cells).alias("x")).select("time", "x.*")


def cox(df: DataFrame, duration: str, event: str, xs: Sequence[str], steps: int = 30, tolerance: float = 1e-8) -> DataFrame:
    """``term, coefficient, hazard_ratio, se, z, p`` of proportional hazards, ties by Breslow's rule, by Newton's steps.

    A step sums weights and weighted products over each time, then along times in ranges; rows with nulls or non-finite values are left out.
    """
    ok = df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull())
    for x in xs:
        ok = ok.filter(finite(F.col(x), dtype(df, x)))
    k = len(xs)
    # Centred, which changes no coefficient, so that weights stay in range.
    head = ok.agg(F.sum(F.col(event).cast("int")), *[F.avg(F.col(x).cast("double")) for x in xs]).first()
    if not head[0]:
        raise Rejected("no events")
    names = [f"__x{i}" for i in range(k)]
    rows = cut(ok.select(F.col(duration).alias("time"), F.col(event).cast("int").alias("d"), *[(F.col(x).cast("double") - head[i + 1]).alias(names[i]) for i, x in enumerate(xs)]))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta = np.zeros(k)
    for _ in range(steps):
        w = F.exp(linear([0.0, *beta], names))
        sums = {"s": F.sum(w)} | {f"a{i}": F.sum(w * F.col(names[i])) for i in range(k)} | {f"b{i}_{j}": F.sum(w * F.col(names[i]) * F.col(names[j])) for i, j in pairs}
        dead = {"d": F.sum("d")} | {f"e{i}": F.sum(F.col("d") * F.col(names[i])) for i in range(k)}
        at = rows.groupBy("time").agg(*[c.alias(n) for n, c in (sums | dead).items()])
        risk = running(at, [F.col("time").desc()], {f"r_{n}": F.col(n) for n in sums}).filter("d > 0")
        mean = [F.col(f"r_a{i}") / F.col("r_s") for i in range(k)]
        got = risk.agg(
            *[F.sum(F.col(f"e{i}") - F.col("d") * mean[i]) for i in range(k)], *[F.sum(F.col("d") * (F.col(f"r_b{i}_{j}") / F.col("r_s") - mean[i] * mean[j])) for i, j in pairs]
        ).first()
        information = np.zeros((k, k))
        for n, (i, j) in enumerate(pairs):
            information[i, j] = information[j, i] = got[k + n]
        try:
            step = np.linalg.solve(information, np.array(got[:k], float))
        except np.linalg.LinAlgError as e:
            raise Rejected("columns depend on each other") from e
        if np.abs(step).max() <= tolerance * (1 + np.abs(beta).max()):
            break
        beta = beta + step * min(1.0, 5.0 / np.abs(step).max())
    else:
        raise Rejected("the fit didn't settle")
    se = np.sqrt(np.diag(np.linalg.inv(information)))
    out = [(x, float(b), math.exp(b), float(s), float(b / s), float(normal_sf2(abs(b / s)))) for x, b, s in zip(xs, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, hazard_ratio double, se double, z double, p double")

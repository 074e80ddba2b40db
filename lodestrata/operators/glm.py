"""Generalised linear models, and causal contrasts that rest on them.

A fit reads the rows once an iteration, as one aggregate of a few sums; rows are never moved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_sf2
from ..functions.values import Rejected, dtype, finite
from .stats import _one

#: Mean and variance of each family as functions of the linear predictor, canonical links.
FAMILIES = {
    "gaussian": (lambda e: e, lambda m: F.lit(1.0)),
    "binomial": (lambda e: 1 / (1 + F.exp(-e)), lambda m: m * (1 - m)),
    "poisson": (F.exp, lambda m: m),
}


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(finite(F.col(c), dtype(df, c)))
    return df


def linear(beta: Sequence[float], xs: Sequence[str]) -> Column:
    out = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], xs, strict=True):
        out = out + F.lit(float(b)) * F.col(x).cast("double")
    return out


def _fitted(df: DataFrame, y: str, xs: Sequence[str], family: str, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Coefficients, information, sum of squared scores, Pearson's statistic and rows."""
    if family not in FAMILIES:
        raise Rejected(family)
    mean, variance = FAMILIES[family]
    rows, k = _complete(df, [y, *xs]), len(xs) + 1
    target, terms = F.col(y).cast("double"), [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    low, high, average, count = rows.agg(F.min(target), F.max(target), F.avg(target), F.count(F.lit(1))).first()
    if not count or family == "binomial" and not 0 <= low <= high <= 1 or family == "poisson" and low < 0:
        raise Rejected(f"{y!r} doesn't fit the family {family}, or there are no rows")
    beta = np.zeros(k)
    if family == "poisson":
        beta[0] = math.log(max(average, 1e-8))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(steps):
        m = mean(linear(beta, xs))
        w, r = variance(m), target - m
        got = rows.agg(
            *[F.sum(w * terms[i] * terms[j]) for i, j in pairs], *[F.sum(r * r * terms[i] * terms[j]) for i, j in pairs], *[F.sum(r * t) for t in terms], F.sum(F.try_divide(r * r, w))
        ).first()
        information, scores = np.zeros((k, k)), np.zeros((k, k))
        for at, (i, j) in enumerate(pairs):
            information[i, j] = information[j, i] = got[at]
            scores[i, j] = scores[j, i] = got[len(pairs) + at]
        gradient = np.array(got[2 * len(pairs) : 2 * len(pairs) + k], float)
        # The least squares step, damped so that a far start can't overflow.
        step = np.linalg.lstsq(information, gradient, rcond=None)[0]
        if np.abs(step).max() <= tolerance * (1 + np.abs(beta).max()):
            return beta, information, scores, float(got[-1] or 0.0), count
        beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300) if family != "gaussian" else 1.0)
    raise Rejected("the fit didn't settle: classes may be parted perfectly")


def glm(df: DataFrame, y: str, xs: Sequence[str], family: str = "binomial", errors: str = "model", steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``term, coefficient, se, z, p``; rows with a null or non-finite value are left out.

    ``errors``: ``model`` (from the information; gaussian with the residual variance) or ``robust`` (sandwich, n / (n - k)).
    """
    beta, information, scores, pearson, n = _fitted(df, y, xs, family, steps, tolerance)
    k = len(beta)
    if n <= k:
        raise Rejected("fewer rows than coefficients")
    try:
        inverse = np.linalg.inv(information)
    except np.linalg.LinAlgError as e:
        raise Rejected("columns depend on each other") from e
    if errors == "robust":
        cov = inverse @ scores @ inverse * n / (n - k)
    elif errors == "model":
        cov = inverse * (pearson / (n - k) if family == "gaussian" else 1.0)
    else:
        raise Rejected(errors)
    se = np.sqrt(np.diag(cov))
    rows = [(name, float(b), float(s), float(b / s) if s else None, float(normal_sf2(abs(b / s))) if s else None) for name, b, s in zip(("intercept", *xs), beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, z double, p double")


def effect(df: DataFrame, outcome: str, treatment: str, xs: Sequence[str], method: str = "aipw", clip: float = 0.01) -> DataFrame:
    """``effect, se, n, trimmed``: average effect of a binary treatment given ``xs``.

    ``regression``: outcome models of both arms; ``ipw``: outcomes weighted by the inverse of a logistic propensity, weights of an
    arm summing to one; ``aipw``: both, right if either model is.  Propensities are held within ``clip`` of 0 and 1, ``trimmed`` counts such rows.
    """
    if method not in ("regression", "ipw", "aipw"):
        raise Rejected(method)
    t = F.col(treatment).cast("int")
    rows = _complete(df, [outcome, *xs]).filter(t.isin(0, 1)).withColumn("__t", t)
    y = F.col(outcome).cast("double")
    m1 = m0 = F.lit(0.0)
    if method != "ipw":
        m1, m0 = (linear(_fitted(rows.filter(F.col("__t") == a), outcome, xs, "gaussian", 5, 1e-7)[0], xs) for a in (1, 0))
    e = raw = F.lit(0.5)
    if method != "regression":
        raw = 1 / (1 + F.exp(-linear(_fitted(rows, "__t", xs, "binomial", 60, 1e-9)[0], xs)))
        e = F.least(F.greatest(raw, F.lit(clip)), F.lit(1 - clip))
    one, zero = F.col("__t") == 1, F.col("__t") == 0
    trimmed = F.count(F.when(raw != e, 1))
    if method == "ipw":
        w1, w0 = F.when(one, 1 / e).otherwise(0.0), F.when(zero, 1 / (1 - e)).otherwise(0.0)
        a, b = rows.agg(F.sum(w1 * y) / F.sum(w1), F.sum(w0 * y) / F.sum(w0)).first()
        influence = w1 * (y - a) - w0 * (y - b)
        n, second, cut = rows.agg(F.count(F.lit(1)), F.avg(influence * influence), trimmed).first()
        return _one(df, effect=a - b, se=math.sqrt(second / n), n=n, trimmed=cut)
    part = m1 - m0
    if method == "aipw":
        part = part + F.when(one, (y - m1) / e).otherwise(0.0) - F.when(zero, (y - m0) / (1 - e)).otherwise(0.0)
    n, mean, var, cut = rows.agg(F.count(F.lit(1)), F.avg(part), F.var_samp(part), trimmed).first()
    # Standard errors of a regression by itself would need those of its coefficients.
    return _one(df, effect=mean, se=math.sqrt(var / n) if method == "aipw" else None, n=n, trimmed=cut)


def matched(df: DataFrame, outcome: str, treatment: str, strata: Sequence[str]) -> DataFrame:
    """``effect, treated, unmatched``: effect on the treated by exact matching on ``strata``, null being a value; treated rows of strata without controls are counted."""
    t = F.col(treatment).cast("int")
    y = F.when(finite(F.col(outcome), dtype(df, outcome)), F.col(outcome).cast("double"))
    n = lambda a: F.count(F.when(t == a, y))
    cells = df.groupBy(*strata).agg(n(1).alias("n1"), n(0).alias("n0"), F.avg(F.when(t == 1, y)).alias("y1"), F.avg(F.when(t == 0, y)).alias("y0"))
    both = F.when(F.col("n0") > 0, F.col("n1"))
    return cells.agg((F.sum(both * (F.col("y1") - F.col("y0"))) / F.sum(both)).alias("effect"), F.coalesce(F.sum(both), F.lit(0)).alias("treated"), F.coalesce(F.sum(F.when(F.col("n0") == 0, F.col("n1"))), F.lit(0)).alias("unmatched"))

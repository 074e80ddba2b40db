"""Distribution functions for p-values and intervals, in plain Python.

They take a few scalars at the end of a distributed aggregate, so they needn't be vectorised.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + n / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * out


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if math.isfinite(t) else 0.0


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_cdf(x / 2, df / 2)


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def quantile(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """Inverse of a distribution function by halving."""
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    return quantile(lambda t: 1 - t_sf2(t, df) / 2, p, 0.0, 10.0)


# Coefficients of the rational approximations of the normal quantile (Wichura, Applied Statistics 37, 1988, AS 241),
# from the constant term up: centre, middle and tail, each numerator and denominator.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _rational(x: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    horner = lambda cs: reduce(lambda acc, c: acc * x + F.lit(c), reversed(cs[:-1]), F.lit(cs[-1]))
    return horner(parts[0]) / horner(parts[1])


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile as a column, for 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, _rational(r - 1.6, _MIDDLE)).otherwise(_rational(r - 5.0, _TAIL))
    return F.when(F.abs(q) <= 0.425, q * _rational(0.180625 - q * q, _CENTRE)).otherwise(F.signum(q) * outer)


def normal_cdf(z: Column) -> Column:
    """The standard normal's distribution function as a column: a series near 0, a continued fraction beyond 3."""
    x = F.abs(z)
    pdf = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    terms = F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    series = F.aggregate(terms, F.lit(1.0), lambda acc, k: 1 + acc * x * x / (2 * k + 1))
    fraction = F.aggregate(terms, x.cast("double"), lambda acc, k: x + k / acc)
    upper = F.when(x < 3, 0.5 - pdf * x * series).otherwise(pdf / fraction)
    return F.when(z < 0, upper).otherwise(1 - upper)

"""Tests, models from moments, sampling, experiments, survival, causal contrasts.

Data are reduced by aggregates to a few moments; p-values follow on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import NORMAL, chi2_sf, f_sf, normal_sf2, t_quantile, t_sf2
from ..functions.values import Rejected, dtype, finite
from .running import cut, running
from .windows import average_rank


def moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """``g, n, mean, var`` of finite values."""
    ok = finite(F.col(value), dtype(df, value)) & F.col(group).isNotNull()
    return df.filter(ok).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def _one(frame: DataFrame, /, **values) -> DataFrame:
    return frame.sparkSession.createDataFrame([tuple(float(v) if v is not None else None for v in values.values())], ", ".join(f"{k} double" for k in values))


def welch_t(df: DataFrame, value: str, group: str, first: object, second: object, level: float = 0.95) -> DataFrame:
    """First minus second group."""
    m = {r.g: r for r in moments(df, value, group).filter(F.col("g").isin([first, second])).collect()}
    a, b = m[first], m[second]
    va, vb = a["var"] / a.n, b["var"] / b.n
    se = math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    t, half = (a.mean - b.mean) / se, t_quantile((1 + level) / 2, dof) * se
    return _one(df, effect=a.mean - b.mean, t=t, df=dof, p=t_sf2(t, dof), low=a.mean - b.mean - half, high=a.mean - b.mean + half)


def paired_t(df: DataFrame, before: str, after: str) -> DataFrame:
    d = F.col(after) - F.col(before)
    n, mean, sd = df.filter(d.isNotNull()).agg(F.count(F.lit(1)), F.avg(d), F.stddev_samp(d)).first()
    t = mean / (sd / math.sqrt(n))
    return _one(df, effect=mean, t=t, df=n - 1, p=t_sf2(t, n - 1))


def anova(df: DataFrame, value: str, group: str, welch: bool = False) -> DataFrame:
    rows = moments(df, value, group).collect()
    k, n = len(rows), sum(r.n for r in rows)
    grand = sum(r.n * r.mean for r in rows) / n
    between, within = sum(r.n * (r.mean - grand) ** 2 for r in rows), sum((r.n - 1) * r["var"] for r in rows)
    if not welch:
        f = between / (k - 1) / (within / (n - k))
        return _one(df, f=f, df1=k - 1, df2=n - k, p=f_sf(f, k - 1, n - k), eta2=between / (between + within))
    w = [r.n / r["var"] for r in rows]
    m = sum(x * r.mean for x, r in zip(w, rows, strict=True)) / sum(w)
    lam = sum((1 - x / sum(w)) ** 2 / (r.n - 1) for x, r in zip(w, rows, strict=True))
    f = sum(x * (r.mean - m) ** 2 for x, r in zip(w, rows, strict=True)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
    d2 = (k * k - 1) / (3 * lam)
    return _one(df, f=f, df1=k - 1, df2=d2, p=f_sf(f, k - 1, d2), eta2=between / (between + within))


def _ranks(df: DataFrame, value: str, group: str) -> tuple[list, float]:
    """``g, n, ranks`` and the sum of t³ - t over ties."""
    ok = df.filter(finite(F.col(value), dtype(df, value)) & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ties = ok.groupBy("v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t"))).first()[0] or 0.0
    return average_rank(ok, "v", "r").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("ranks")).orderBy("g").collect(), ties


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first group in order, with ties and continuity corrected; rank-biserial effect."""
    ranked, ties = _ranks(df, value, group)
    if len(ranked) != 2:
        raise Rejected(f"two groups are needed, not {len(ranked)}")
    a, b = ranked
    u = a.ranks - a.n * (a.n + 1) / 2
    n = a.n + b.n
    sd = math.sqrt(a.n * b.n / 12 * (n + 1 - ties / (n * (n - 1))))
    z = max(0.0, abs(u - a.n * b.n / 2) - 0.5) / sd
    return _one(df, u=u, z=z, p=normal_sf2(z), effect=2 * u / (a.n * b.n) - 1)


def wilcoxon(df: DataFrame, before: str, after: str) -> DataFrame:
    d = df.select((F.col(after) - F.col(before)).alias("d")).filter("d <> 0").select(F.abs("d").alias("m"), (F.col("d") > 0).alias("up"))
    ties = d.groupBy("m").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t"))).first()[0] or 0.0
    n, plus = average_rank(d, "m", "r").agg(F.count(F.lit(1)), F.sum(F.when(F.col("up"), F.col("r")).otherwise(0.0))).first()
    total = n * (n + 1) / 2
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (plus - total / 2) / sd
    return _one(df, w=min(plus, total - plus), z=z, p=normal_sf2(z), effect=2 * plus / total - 1)


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    rows, ties = _ranks(df, value, group)
    n, k = sum(r.n for r in rows), len(rows)
    h = (12 / (n * (n + 1)) * sum(r.ranks**2 / r.n for r in rows) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return _one(df, h=h, df=k - 1, p=chi2_sf(h, k - 1), epsilon2=max(0.0, (h - k + 1) / (n - k)))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence without Yates' correction, and Cramér's V."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    n, r, c, s = cells.join(ra, "a").join(rb, "b").agg(F.sum("n"), F.count_distinct("a"), F.count_distinct("b"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb")))).first()
    x, dof = n * (s - 1), (r - 1) * (c - 1)
    return _one(df, chi2=x, df=dof, p=chi2_sf(x, dof), cramer_v=math.sqrt(x / (n * min(r - 1, c - 1))))


def fisher_2x2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sided exact p of a table of two booleans."""
    n11, n10, n01, n00 = df.agg(*[F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1)) for x, y in ((True, True), (True, False), (False, True), (False, False))]).first()
    r, c, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    lf = math.lgamma
    p = lambda k: math.exp(lf(r + 1) + lf(n - r + 1) + lf(c + 1) + lf(n - c + 1) - lf(n + 1) - lf(k + 1) - lf(r - k + 1) - lf(c - k + 1) - lf(n - r - c + k + 1))
    seen = p(n11)
    total = sum(q for k in range(max(0, r + c - n), min(r, c) + 1) if (q := p(k)) <= seen * (1 + 1e-7))
    return _one(df, odds_ratio=n11 * n00 / (n10 * n01) if n10 * n01 else math.inf, p=min(1.0, total))


def pearson(df: DataFrame, x: str, y: str, level: float = 0.95) -> DataFrame:
    ok = df.filter(finite(F.col(x), dtype(df, x)) & finite(F.col(y), dtype(df, y)))
    n, r = ok.agg(F.count(F.lit(1)), F.corr(x, y)).first()
    t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))
    z, half = math.atanh(r), NORMAL.inv_cdf((1 + level) / 2) / math.sqrt(n - 3)
    return _one(df, n=n, r=r, p=t_sf2(t, n - 2), low=math.tanh(z - half), high=math.tanh(z + half))


def adjust(p: Sequence[float], method: str = "holm") -> list[float]:
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    out = [0.0] * m
    if method == "bonferroni":
        return [min(1.0, m * x) for x in p]
    if method == "holm":
        high = 0.0
        for k, i in enumerate(order):
            high = max(high, (m - k) * p[i])
            out[i] = min(1.0, high)
        return out
    if method == "bh":
        low = 1.0
        for k in range(m - 1, -1, -1):
            low = min(low, m / (k + 1) * p[order[k]])
            out[order[k]] = low
        return out
    if method == "none":
        return list(p)
    raise Rejected(method)


def ols(df: DataFrame, y: str, xs: Sequence[str], weight: str | None = None) -> DataFrame:
    """``term, coefficient, se, t, p``: normal equations from one aggregate, so rows are read once and never moved."""
    ok = df
    for c in (y, *xs, *([weight] if weight else [])):
        ok = ok.filter(finite(F.col(c), dtype(df, c)))
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    target = F.col(y).cast("double")
    k = len(terms)
    sums = [F.sum(w * terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * t * target) for t in terms] + [F.sum(w * target * target), F.count(F.lit(1))]
    got = [float(v or 0) for v in ok.agg(*sums).first()]
    xx, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = got[at]
            at += 1
    xy, yy, n = np.array(got[at : at + k]), got[at + k], got[at + k + 1]
    beta = np.linalg.solve(xx, xy)
    s2 = max(0.0, yy - beta @ xy) / (n - k)
    se = np.sqrt(np.diag(np.linalg.inv(xx)) * s2)
    rows = [(name, float(b), float(s), float(b / s) if s else None, float(t_sf2(b / s, n - k)) if s else None) for name, b, s in zip(("intercept", *xs), beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, t double, p double")


def sample(df: DataFrame, key: str, n: int, seed: str = "s", strata: Sequence[str] = ()) -> DataFrame:
    """``n`` rows (of each stratum) by the smallest seeded hash of the key, with ``inclusion``; more than there are is refused."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__size")) if strata else df.agg(F.count(F.lit(1)).alias("__size"))
    if sizes.filter(F.col("__size") < n).limit(1).count():
        raise Rejected("more asked for than there is")
    if not strata:
        size = sizes.first()[0]
        return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h").withColumn("inclusion", F.lit(n / size))
    # The rank of a window with a limit is cut in each task before the shuffle.
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))).filter(F.col("__r") <= n).drop("__r")
    return ranked.join(sizes, list(strata)).withColumn("inclusion", n / F.col("__size")).drop("__size")


def sample_clusters(df: DataFrame, cluster: str, n: int, seed: str = "s") -> DataFrame:
    return df.join(sample(df.select(cluster).distinct(), cluster, n, seed).drop("inclusion"), cluster, "left_semi")


def bootstrap(df: DataFrame, key: str, value: str, replicates: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """``mean, low, high``: percentile interval of the mean from Poisson weights, which a row draws by itself from hashes, so nothing is gathered."""
    rows = df.filter(finite(F.col(value), dtype(df, value)))

    def weight(r: int):
        u = (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(r)), F.lit(1 << 30)) + 0.5) / (1 << 30)
        w, term = F.lit(0), 1.0
        total = 0.0
        for i in range(1, 10):
            total += math.exp(-1) * term
            term /= i
            w = w + (u > total).cast("int")
        return w

    sums = rows.agg(F.avg(value).alias("mean"), *[(F.sum(weight(r) * F.col(value)) / F.sum(weight(r))).alias(f"r{r}") for r in range(replicates)])
    cells = F.array_sort(F.array(*[F.col(f"r{r}") for r in range(replicates)]))
    at = lambda p: F.get(cells, F.lit(min(replicates - 1, max(0, round(p * (replicates - 1))))))
    return sums.select("mean", at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def power_mean(effect: float, sd: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows an arm to see a difference of means."""
    return math.ceil(2 * ((NORMAL.inv_cdf(1 - alpha / 2) + NORMAL.inv_cdf(power)) * sd / effect) ** 2)


def power_proportion(p1: float, p2: float, alpha: float = 0.05, power: float = 0.8) -> int:
    mean = (p1 + p2) / 2
    a = NORMAL.inv_cdf(1 - alpha / 2) * math.sqrt(2 * mean * (1 - mean))
    b = NORMAL.inv_cdf(power) * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return math.ceil(((a + b) / (p1 - p2)) ** 2)


def assign(df: DataFrame, key: str, arms: dict[str, float], seed: str = "a") -> DataFrame:
    """Arm by a seeded hash of the key; the same key always gets the same."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48) * sum(arms.values())
    out, top = F.lit(list(arms)[-1]), sum(arms.values())
    for name in reversed(list(arms)):
        top -= arms[name]
        out = F.when(u >= F.lit(top + arms[name]), out).otherwise(F.lit(name))
    return df.withColumn("arm", out)


def experiment(df: DataFrame, arm: str, outcome: str, control: str, treatment: str, planned: tuple[float, float] = (1, 1), srm: float = 0.001) -> DataFrame:
    """Treatment minus control; refused if the arms' sizes are off the plan."""
    m = {r.g: r for r in moments(df, outcome, arm).filter(F.col("g").isin([control, treatment])).collect()}
    c, t = m[control], m[treatment]
    n = c.n + t.n
    want = [n * x / sum(planned) for x in planned]
    if (p := chi2_sf(sum((o - e) ** 2 / e for o, e in zip((c.n, t.n), want, strict=True)), 1)) < srm:
        raise Rejected(f"sizes of arms are off the plan (p {p:.2g})")
    out = welch_t(df, outcome, arm, treatment, control)
    return out.withColumn("relative", F.col("effect") / c.mean)


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """``g, time, at_risk, events, survival, variance`` at times with events; events come before censoring at the same time.

    Sums run over distinct times, in ranges of their order; a group's start is taken off.
    """
    keys = [F.col(group).alias("g")] if group else [F.lit("all").alias("g")]
    t = df.filter(F.col(duration).isNotNull()).groupBy(*keys, F.col(duration).alias("time")).agg(F.sum(F.col(event).cast("int")).alias("events"), F.count(F.lit(1)).alias("left"))
    d, n = F.col("events"), F.col("at_risk")
    down = running(t, [F.col("g"), F.col("time").desc()], {"at_risk": F.col("left"), "__at": F.lit(1)})
    risk = _from_start(down, "g", {"at_risk": F.col("left")}).filter("events > 0")
    terms = {
        "__dead": (d == n).cast("int"),
        "__log": F.coalesce(F.log(F.when(d < n, 1 - d / n)), F.lit(0.0)),
        "__known": F.when(d < n, 1).otherwise(0),
        "__greenwood": F.coalesce(F.try_divide(d, n * (n - d)), F.lit(0.0)),
    }
    upto = _from_start(running(risk, [F.col("g"), F.col("time")], terms | {"__at": F.lit(1)}), "g", terms)
    s = F.when(F.col("__dead") > 0, 0.0).otherwise(F.exp("__log"))
    out = upto.select("g", "time", "at_risk", "events", s.alias("survival"), F.when(F.col("__known") > 0, F.col("__greenwood")).alias("__greenwood"))
    return out.withColumn("variance", F.col("survival") ** 2 * F.col("__greenwood")).drop("__greenwood")


def _from_start(df: DataFrame, group: str, sums: dict) -> DataFrame:
    """Running sums over groups one after the other become sums within each: what stands before a group's first row is taken off."""
    df = cut(df)
    starts = df.groupBy(F.col(group).alias("__of")).agg(*[F.min_by(F.col(n) - c, F.col("__at")).alias(f"__s{i}") for i, (n, c) in enumerate(sums.items())])
    out = df.join(starts, F.col(group).eqNullSafe(F.col("__of")))
    return out.withColumns({n: F.col(n) - F.col(f"__s{i}") for i, n in enumerate(sums)}).drop("__of", "__at", *[f"__s{i}" for i in range(len(sums))])


def log_rank(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Two groups."""
    t = df.groupBy(F.col(duration).alias("time")).pivot(group).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count(F.lit(1)).alias("n"))
    names = sorted({c.rsplit("_", 1)[0] for c in t.columns if c != "time"})
    if len(names) != 2:
        raise Rejected("two groups are needed")
    t = t.fillna(0)
    a, b = names
    left = running(t, [F.col("time").desc()], {"__na": F.col(f"{a}_n"), "__nb": F.col(f"{b}_n")})
    r = left.select("time", F.col(f"{a}_d").alias("da"), F.col(f"{b}_d").alias("db"), F.col("__na").alias("na"), F.col("__nb").alias("nb"))
    d, n = F.col("da") + F.col("db"), F.col("na") + F.col("nb")
    expected = d * F.col("na") / n
    var = F.when(n > 1, d * F.col("na") * F.col("nb") * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    o, e, v = r.agg(F.sum("da"), F.sum(expected), F.sum(var)).first()
    x = (o - e) ** 2 / v
    return _one(df, chi2=x, p=chi2_sf(x, 1), observed=o, expected=e)


def did(df: DataFrame, unit: str, time: str, treated: str, outcome: str, periods: tuple) -> DataFrame:
    """Change from the second to the third period, treated against others, and the placebo change before."""
    a, b, c = (F.max(F.when(F.col(time) == p, F.col(outcome))) for p in periods)
    u = df.groupBy(unit).agg(F.max(F.col(treated).cast("int")).alias("t"), a.alias("y1"), b.alias("y2"), c.alias("y3"))
    if u.filter("y1 is null or y2 is null or y3 is null").limit(1).count():
        raise Rejected("not balanced")
    mean = lambda expr, t: F.avg(F.when(F.col("t") == t, expr))
    post, pre = F.col("y3") - F.col("y2"), F.col("y2") - F.col("y1")
    return u.agg((mean(post, 1) - mean(post, 0)).alias("effect"), (mean(pre, 1) - mean(pre, 0)).alias("placebo"), F.count(F.lit(1)).alias("units"))


def wald_iv(df: DataFrame, outcome: str, treatment: str, instrument: str) -> DataFrame:
    """Reduced form over first stage, for a binary instrument; refused when the first stage is weak (F < 10)."""
    z = F.col(instrument).cast("int")
    g = df.groupBy(z.alias("z")).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("y"), F.avg(F.col(treatment).cast("double")).alias("d"), F.var_samp(F.col(treatment).cast("double")).alias("v"))
    r = {x.z: x for x in g.collect()}
    first = r[1].d - r[0].d
    pooled = ((r[1].n - 1) * r[1].v + (r[0].n - 1) * r[0].v) / (r[1].n + r[0].n - 2)
    f = first**2 / (pooled * (1 / r[1].n + 1 / r[0].n)) if pooled else math.inf
    if f < 10:
        raise Rejected(f"weak instrument: F {f:.2g}")
    return _one(df, effect=(r[1].y - r[0].y) / first, first_stage=first, f=f)


def beta_binomial(df: DataFrame, success: str, a: float = 1, b: float = 1) -> DataFrame:
    s, n = df.filter(F.col(success).isNotNull()).agg(F.sum(F.col(success).cast("int")), F.count(F.lit(1))).first()
    s = s or 0
    x, y = a + s, b + n - s
    return _one(df, alpha=x, beta=y, mean=x / (x + y), sd=math.sqrt(x * y / ((x + y) ** 2 * (x + y + 1))))


def rubin(estimates: Sequence[float], variances: Sequence[float]) -> tuple[float, float]:
    """Mean and total variance over multiply imputed data."""
    m = len(estimates)
    mean = sum(estimates) / m
    return mean, sum(variances) / m + (1 + 1 / m) * sum((e - mean) ** 2 for e in estimates) / (m - 1)

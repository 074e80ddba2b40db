"""Models, survival, signals and columns that look back, held against brute force."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from lodestrata.functions.values import Rejected
from lodestrata.operators import glm, quality, running, signals, survival, timeseries, windows
from lodestrata.plans import further_queries, more_queries, queries, registry, report_queries  # noqa: F401


@pytest.mark.parametrize("rows", [4, 7, 1000])
def test_looking_back_over_blocks(spark, rows):
    # One group holds most rows, one is null, one has a single row; blocks end within groups.
    made = [(g, t, float((t * 37) % 11)) for g, n in (("a", 60), (None, 9), ("b", 1), ("c", 13)) for t in range(n)]
    random.Random(3).shuffle(made)
    df = spark.createDataFrame(made, "g string, t int, v double")
    from pyspark.sql import functions as F

    got = running.looking_back(df, ["t"], ["g"], 3, lambda w: {"one": F.lag("v", 1).over(w), "three": F.lag("v", 3).over(w)}, rows).collect()
    at = {(g, t): v for g, t, v in made}
    assert len(got) == len(made)
    assert all((r.one, r.three) == (at.get((r.g, r.t - 1)), at.get((r.g, r.t - 3))) for r in got)
    with pytest.raises(Rejected):
        running.looking_back(df, ["t"], ["g"], rows + 1, lambda w: {}, rows)


def test_lags_and_autocorrelation(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK_ROWS", 8)
    values = [math.sin(i / 3) + i % 5 for i in range(50)]
    df = spark.createDataFrame([(i, v, None if i < 25 else "x") for i, v in enumerate(values)], "t int, v double, g string")
    c = np.array(values) - np.mean(values)
    got = {r.lag: r.acf for r in timeseries.acf(df, "t", "v", 3).collect()}
    assert all(abs(got[k] - (c[k:] @ c[:-k]) / (c @ c)) < 1e-9 for k in (1, 2, 3))
    by_group = {(r.g, r.lag): r.acf for r in timeseries.acf(df, "t", "v", 2, ["g"]).collect()}
    for g, part in ((None, values[:25]), ("x", values[25:])):
        c = np.array(part) - np.mean(part)
        assert all(abs(by_group[g, k] - (c[k:] @ c[:-k]) / (c @ c)) < 1e-9 for k in (1, 2))
    rolled = {r.t: r.rolling_4 for r in windows.lag_features(df, "v", "t", [1], 4).collect()}
    assert rolled[3] is None and abs(rolled[20] - np.mean(values[16:20])) < 1e-9
    mase = signals.scaled_error(timeseries.seasonal_naive(df, "t", "v", 5), "t", "v", "seasonal").first().mase
    a = np.array(values)
    assert abs(mase - np.abs(a[5:] - a[:-5]).mean() / np.abs(np.diff(a)).mean()) < 1e-9
    # Partial autocorrelation by solving the Yule-Walker equations.
    c = a - a.mean()
    r = [1.0, *[(c[k:] @ c[:-k]) / (c @ c) for k in (1, 2, 3)]]
    partial = {x.lag: x.pacf for x in signals.pacf(df, "t", "v", 3).collect()}
    for k in (1, 2, 3):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(partial[k] - np.linalg.solve(system, r[1 : k + 1])[-1]) < 1e-9


def test_spectra_as_by_the_fast_transform(spark):
    v = [math.cos(2 * math.pi * 3 * i / 32) + 0.2 * (i % 7) for i in range(64)]
    df = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    got = {r.k: r.power for r in signals.periodogram(df, "i", "v", [0, 6, 32], 64).collect()}
    full = np.abs(np.fft.rfft(v)) ** 2 / 64
    assert all(abs(got[k] - full[k] * (1 if k in (0, 32) else 2)) < 1e-6 for k in got)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    parts = [np.array(v[a : a + 32]) for a in (0, 16, 32)]
    means = np.mean([np.abs(np.fft.rfft((p - p.mean()) * taper)) ** 2 * 2 / (taper @ taper) for p in parts], axis=0)
    got = {r.k: r.power for r in signals.welch(df, "i", "v", [2, 3, 5], 32).collect()}
    assert all(abs(got[k] - means[k]) < 1e-6 for k in got)


def partial_likelihood(rows, beta):
    total = 0.0
    for t, d, *x in rows:
        if d:
            risk = sum(math.exp(float(np.dot(beta, y))) for u, _, *y in rows if u >= t)
            total += float(np.dot(beta, x)) - math.log(risk)
    return total


def test_cox_is_where_the_partial_likelihood_is_highest(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(1, 20), rng.random() < 0.7, float(rng.random() < 0.5), rng.gauss(3, 2)) for _ in range(120)]
    df = spark.createDataFrame([*rows, (5, None, 1.0, 1.0), (None, True, 1.0, 1.0), (5, True, None, 1.0), (5, True, 1.0, math.nan)], "t int, d boolean, a double, b double")
    got = survival.cox(df, "t", "d", ["a", "b"]).collect()
    beta = np.array([r.coefficient for r in got])
    best = partial_likelihood(rows, beta)
    h = 1e-3
    slope = [(partial_likelihood(rows, beta + e) - partial_likelihood(rows, beta - e)) / (2 * h) for e in np.eye(2) * h]
    assert np.abs(slope).max() < 1e-3
    curve = [-(partial_likelihood(rows, beta + e) - 2 * best + partial_likelihood(rows, beta - e)) / h**2 for e in np.eye(2) * h]
    information = np.array([[curve[0], 0.0], [0.0, curve[1]]])
    cross = [partial_likelihood(rows, beta + np.array(s) * h) for s in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
    information[0, 1] = information[1, 0] = -(cross[0] - cross[1] - cross[2] + cross[3]) / (4 * h * h)
    assert np.allclose([r.se for r in got], np.sqrt(np.diag(np.linalg.inv(information))), rtol=1e-3)
    with pytest.raises(Rejected):
        survival.cox(df.filter("not d"), "t", "d", ["a"])


def test_hazards_with_delayed_entry_and_competing_causes(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(0, 6), rng.randrange(3, 15), rng.choice([None, 1, 2])) for _ in range(80)]
    df = spark.createDataFrame(rows, "e int, t int, c int").selectExpr("*", "c is not null as d")
    got = {r.time: (r.at_risk, r.events) for r in survival.nelson_aalen(df, "t", "d", "e").collect()}
    kept = [r for r in rows if r[0] < r[1]]
    for t in {r[1] for r in kept if r[2]}:
        assert got[t] == (sum(1 for e, u, _ in kept if e < t <= u), sum(1 for _, u, c in kept if u == t and c))
    alive, total, want = 1.0, {1: 0.0, 2: 0.0}, {}
    for t in sorted({r[1] for r in rows if r[2]}):
        n = sum(1 for r in rows if r[1] >= t)
        for k in (1, 2):
            total[k] += alive * sum(1 for r in rows if r[1] == t and r[2] == k) / n
            want[t, k] = total[k]
        alive *= 1 - sum(1 for r in rows if r[1] == t and r[2]) / n
    found = {(r.time, r.cause): r.incidence for r in survival.cumulative_incidence(df, "t", "c", [1, 2]).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("family", ["gaussian", "binomial", "poisson"])
def test_glm_solves_its_score_equations(spark, family):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    eta = 0.3 + x @ [0.8, -0.5]
    y = {"gaussian": eta + rng.normal(size=300), "binomial": (rng.random(300) < 1 / (1 + np.exp(-eta))).astype(float), "poisson": rng.poisson(np.exp(eta)).astype(float)}[family]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0), (1.0, math.inf, 1.0)], "a double, b double, y double")
    model = glm.glm(df, "y", ["a", "b"], family).collect()
    beta = np.array([r.coefficient for r in model])
    full = np.column_stack([np.ones(300), x])
    m = {"gaussian": lambda e: e, "binomial": lambda e: 1 / (1 + np.exp(-e)), "poisson": np.exp}[family](full @ beta)
    assert np.abs(full.T @ (y - m)).max() < 1e-4
    w = {"gaussian": np.ones(300), "binomial": m * (1 - m), "poisson": m}[family]
    inverse = np.linalg.inv(full.T @ (full * w[:, None]))
    scale = ((y - m) ** 2).sum() / 297 if family == "gaussian" else 1.0
    assert np.allclose([r.se for r in model], np.sqrt(np.diag(inverse) * scale), rtol=1e-5)
    robust = inverse @ (full.T @ (full * ((y - m) ** 2)[:, None])) @ inverse * 300 / 297
    assert np.allclose([r.se for r in glm.glm(df, "y", ["a", "b"], family, "robust").collect()], np.sqrt(np.diag(robust)), rtol=1e-5)


def test_models_refuse_what_they_cannot_fit(spark):
    parted = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    twice = spark.createDataFrame([(float(i), float(i), float(i % 3)) for i in range(12)], "a double, b double, y double")
    for call in (lambda: glm.glm(parted, "y", ["x"]), lambda: glm.glm(twice, "y", ["a", "b"], "gaussian"), lambda: glm.glm(parted, "x", ["y"]), lambda: glm.glm(parted.limit(0), "y", ["x"])):
        with pytest.raises(Rejected):
            call()


def test_causal_contrasts_recover_a_planted_effect(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=3000)
    t = (rng.random(3000) < 1 / (1 + np.exp(-x))).astype(int)
    y = 2.0 * t + 3 * x + rng.normal(size=3000) * 0.1
    df = spark.createDataFrame([(float(a), int(b), float(c), int(a > 0)) for a, b, c in zip(x, t, y)], "x double, t int, y double, s int")
    got = {m: glm.effect(df, "y", "t", ["x"], m).first() for m in ("regression", "ipw", "aipw")}
    assert abs(got["regression"].effect - 2) < 0.05 and abs(got["aipw"].effect - 2) < 0.05 and abs(got["ipw"].effect - 2) < 0.5
    assert 0 < got["aipw"].se < 0.05 and got["ipw"].n == 3000
    r = glm.matched(df, "y", "t", ["s"]).first()
    cells = [(int(((x > 0) == s)[t == 1].sum()), y[(t == 1) & ((x > 0) == s)].mean() - y[(t == 0) & ((x > 0) == s)].mean()) for s in (True, False)]
    assert abs(r.effect - sum(n * d for n, d in cells) / t.sum()) < 1e-9 and (r.treated, r.unmatched) == (t.sum(), 0)


def test_every_query_is_registered_once_and_operators_are_found():
    assert {"glm.glm", "survival.cox", "signals.welch", "sets.union"} & registry.REGISTRY.keys() >= {"glm.glm", "survival.cox", "signals.welch"}
    assert queries.ORACLE_SQL.keys() <= queries.QUERIES.keys()


def test_similar_categories_by_matching_blocks(spark):
    names = ["cold gear", "old gear", "Old Gear", "red plate", "large plate", "abc", "abd", "xyzzy"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "c string")
    got = {(r.a, r.b): (r.similarity, r.same_folded) for r in quality.similar_categories(df, "c", 0.75).collect()}
    want = {}
    for a in names:
        for b in names:
            x, y = a.lower(), b.lower()
            ratio = SequenceMatcher(None, x, y, autojunk=False).ratio()
            if a < b and (x == y or ratio >= 0.75 and min(len(a), len(b)) >= 4):
                want[a, b] = (ratio, x == y)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)

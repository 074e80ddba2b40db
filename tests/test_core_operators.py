"""Value policies and operators on small literal frames."""

import datetime as dt
import math
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.distributions import beta_cdf, chi2_sf, f_sf, t_quantile, t_sf2
from lodestrata.functions.formula import compile_formula
from lodestrata.functions.values import Rejected, exact_cast, literal
from lodestrata.operators import charts, cleaning, events, graph, monitor, privacy, profile, project, quality, relational, stats, text, timeseries, windows
from lodestrata.plans import registry
from lodestrata.sources import readers, sinks
from lodestrata.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_formula_policies(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, True, 4.0)], "a int, b boolean, c double")
    out = df.select(compile_formula(df, 'ifelse(col("b"), 1, 2)').alias("x"), compile_formula(df, 'col("a") / col("c")', "null").alias("y"), compile_formula(df, 'col("b") and col("a") > 5').alias("z"))
    assert [tuple(r) for r in out.collect()] == [(None, None, False), (1, 0.5, False)]
    for bad in ("__import__('os')", 'col("a") + "x"', 'col("nope")', "a.b", "1 if 2 else 3", 'length(col("a"))', "x" * 5000):
        with pytest.raises(Rejected):
            compile_formula(df, bad)
    assert spark.range(1).select(compile_formula(df, "round(2.5, 0)")).first()[0] == 2


def test_lossless_casts_and_literals(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("x",), (None,), ("00012",), ("1e3",)], "s string")
    t = df.schema["s"].dataType
    assert [r[0] for r in df.select(exact_cast(F.col("s"), t, "int")).collect()] == [1, None, None, None, 12, None]
    assert [r[0] for r in df.select(exact_cast(F.col("s"), t, "double")).collect()] == [1.0, 1.5, None, None, 12.0, 1000.0]
    d = spark.createDataFrame([(1.5,), (2.0,)], "d double")
    assert [r[0] for r in d.select(exact_cast(F.col("d"), d.schema["d"].dataType, "int")).collect()] == [None, 2]
    for value, kind in (("1.5", "int"), ("300", "tinyint"), ("nan", "double"), ("2024-02-30", "date"), ("1.234", "decimal(5,2)")):
        with pytest.raises(Rejected):
            literal(value, spark.sql(f"SELECT CAST(NULL AS {kind}) x").schema["x"].dataType)


def test_predicates_leave_out_null_and_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (math.inf,), (3.0,)], "v double")
    assert rows(project.where(df, ("v", "ne", 1))) == [(3.0,)]
    assert project.where(df, ("v", "is_nan")).count() == project.where(df, ("v", "is_inf")).count() == project.where(df, ("v", "is_null")).count() == 1
    plan = project.where(df, ("v", "gt", 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce" not in plan.lower()


def test_joins_count_as_by_hand(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "j int, r string")
    assert [relational.join(left, right, [("k", "j")], h).count() for h in relational.KINDS] == [4, 6, 6, 8]
    assert relational.join(left, right, [("k", "j")], "full", nulls_equal=True).count() == 7
    p = relational.preflight(left, right, [("k", "j")]).first()
    assert (p.inner_rows, p.left_rows, p.right_rows, p.full_rows, p.relationship) == (4, 6, 6, 8, "n:n")
    nan = spark.createDataFrame([(math.nan,)], "f double")
    with pytest.raises(Rejected):
        relational.join(nan, nan.withColumnRenamed("f", "g"), [("f", "g")])


def test_group_pivot_unpivot(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", None)], "k string, h string, v int")
    assert rows(relational.aggregate(df, ["k"], {"n": ("count",), "s": ("sum", "v")})) == [("a", 2, 3), (None, 1, None)]
    assert rows(relational.pivot(df, ["k"], "h", ["x", "y"], "count")) == [("a", 1, 1), (None, 1, 0)]
    assert rows(relational.pivot(df, ["k"], "h", ["x", "y"], "sum", "v")) == [("a", 1, 2), (None, None, None)]
    assert relational.unpivot(df.selectExpr("k", "v", "v AS w"), ["k"], ["v", "w"]).count() == 6
    with pytest.raises(Rejected):
        relational.pivot(df.union(df), ["k"], "h", ["x"], "reject", "v")


def test_cleaning(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 6), (4, None)], "o int, v int")
    assert rows(cleaning.fill_statistic(df, "v", "mean"), "v")[-1] == (6,) and cleaning.fill_statistic(df, "v", "mean").filter("o = 4").first().v == 3
    assert cleaning.fill_statistic(df, "v", "median").filter("o = 4").first().v == 2
    with pytest.raises(Rejected):
        cleaning.fill_statistic(df.filter("o <> 3"), "v", "mean")
    tie = spark.createDataFrame([("x",), ("y",), (None,)], "t string")
    with pytest.raises(Rejected):
        cleaning.fill_mode(tie, "t")
    assert cleaning.fill_mode(tie, "t", choose="x").filter("t = 'x'").count() == 2
    missing = spark.createDataFrame([(1.0, 1), (None, 2), (math.nan, 3), (None, 4)], "a double, k int")
    assert rows(cleaning.drop_missing_rows(missing, ["a"]), "k") == [(1,), (3,)]
    assert rows(cleaning.drop_missing_rows(missing, ["a"], policy="null_nan"), "k") == [(1,)]
    s = spark.createDataFrame([("g", 1, None), ("g", 2, 5), ("g", 3, None), ("h", 1, None)], "g string, o int, v int")
    assert rows(cleaning.ordered_fill(s, "v", ["g"], ["o"], "o")) == [("g", 1, None), ("g", 2, 5), ("g", 3, 5), ("h", 1, None)]
    with pytest.raises(Rejected):
        cleaning.convert(spark.createDataFrame([("1.5",)], "s string"), "s", "int")


def test_dedup_ties_and_directions(spark):
    df = spark.createDataFrame([(1, "k", 2.0), (2, "k", 2.0), (3, "k", 1.0), (4, None, 9.0), (5, None, 9.0)], "o int, k string, v double")
    pick = lambda **kw: [r[0] for r in rows(cleaning.dedup(df, ["k"], ["v"], "o", **kw), "o")]
    assert pick() == [3, 4] and pick(keep="last") == [2, 5] and pick(descending=True) == [1, 4] and pick(keep="last", descending=True) == [3, 5]


def test_profile_and_quality(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (math.nan,), (math.inf,), (-math.inf,)], "v double")
    p = profile.profile(df, "v").first()
    assert (p.nulls, p.nans, p.plus_inf, p.minus_inf, p.valid, p.q50, p["mean"]) == (1, 1, 1, 1, 4, 2.5, 2.5)
    assert profile.weighted_mean(spark.createDataFrame([(10, 1), (20, 3)], "x int, w int"), "x", "w").first()[0] == 17.5
    t = spark.createDataFrame([("a ", 1), ("a", 1), (None, 5)], "s string, n int")
    assert rows(quality.scan(t)) == [("n", 0, 0, 0, False), ("s", 1, 0, 1, False)]
    good, bad = quality.quarantine(t, [{"kind": "range", "column": "n", "max": 3}, {"kind": "required", "column": "s"}])
    assert good.count() == 2 and bad.first().violations == ["range:n", "required:s"]
    assert quality.duplicates(t, ["n"]).count() == 2
    pairs = quality.similar_categories(spark.createDataFrame([("Ankara",), ("ankara",), ("Ankaro",), ("Izmir",)], "c string"), "c")
    assert rows(pairs, "a", "b", "same_folded") == [("Ankara", "ankara", True)]


def test_charts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (math.nan,), (math.inf,)], "x double")
    assert rows(charts.histogram(df, "x", 2)) == [(0, 1.0, 2.5, 2), (1, 2.5, 4.0, 2)]
    b = charts.box(df, "x").first()
    assert (b.q1, b.median, b.q3, b.whisker_low, b.whisker_high) == (1.75, 2.5, 3.25, 1.0, 4.0)
    k = charts.kde(df, "x").collect()
    assert sum(r.density for r in k) * (k[1].x - k[0].x) == pytest.approx(1, abs=0.01)
    assert sum(r.n for r in charts.hexbin(df.select("x", F.col("x").alias("y")), "x", "y", 4).collect()) == 4
    nodes = spark.createDataFrame([("r", None, 0.0), ("a", "r", 0.0), ("b", "a", 2.0), ("c", "a", 3.0)], "n string, p string, v double")
    assert rows(charts.tree(nodes, "n", "p", "v")) == [("a", 1, 5.0), ("b", 2, 2.0), ("c", 2, 3.0), ("r", 0, 5.0)]
    flow = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 2.0)], "s string, t string, w double")
    assert rows(charts.flow_levels(flow, "s", "t", "w"), "node", "level") == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(Rejected):
        charts.flow_levels(spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "s string, t string, w double"), "s", "t", "w")
    assert rows(charts.radar(spark.createDataFrame([("x", 1, 7), ("y", 3, 7)], "e string, a int, b int"), "e", ["a", "b"])) == [("x", "a", 0.0), ("x", "b", 0.5), ("y", "a", 1.0), ("y", "b", 0.5)]


def test_events_and_baskets(spark):
    b = spark.createDataFrame([("t1", "A"), ("t1", "B"), ("t2", "A"), ("t3", "B"), ("t4", None), ("t5", "A"), ("t5", "B")], "t string, i string")
    sets = events.frequent_sets(b, "t", "i", 0.3)
    assert rows(sets) == [(["A", "B"], 2, 0.4), (["A"], 3, 0.6), (["B"], 3, 0.6)]
    r = {tuple(x.antecedent): x for x in events.rules(sets, 5, 0.1).collect()}
    assert r[("A",)].confidence == pytest.approx(2 / 3) and r[("A",)].lift == pytest.approx((2 / 3) / 0.6)
    e = spark.createDataFrame([(1, "view", 0), (1, "cart", 5), (1, "buy", 9), (2, "view", 0), (2, "buy", 3), (3, "cart", 1)], "p int, a string, s long").withColumn("t", F.timestamp_seconds("s"))
    assert [x.entities for x in events.funnel(e, "p", "a", "t", ["view", "cart", "buy"], 100).orderBy("stage").collect()] == [2, 1, 1]
    assert rows(events.follows(e, "p", "a", ["t"])) == [("cart", "buy", 1), ("view", "buy", 1), ("view", "cart", 1)]
    assert rows(events.conformance(e, "p", "a", ["t"], ["view"], [("view", "cart"), ("cart", "buy")], ["buy"]), "p", "fits") == [(1, True), (2, False), (3, False)]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0), ("a", "c", 9.0)], "src string, dst string, w double")
    assert dict(graph.shortest_paths(e, "a", "w", directed=False).collect()) == {"a": 0.0, "b": 2.0, "c": 5.0}
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "node string")
    assert dict(graph.components(e, n).collect()) == {"a": "a", "b": "a", "c": "a", "z": "z"}
    ranks = dict(graph.pagerank(e, tolerance=1e-8).collect())
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] > ranks["b"] > ranks["a"]
    loop = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert graph.degrees(loop).first().degree == 2


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "A"), (3.0, "A"), (2.0, "B"), (3.0, "B"), (4.0, "B")], "x double, g string")
    assert stats.welch_t(df, "x", "g", "A", "B").first().t == pytest.approx(-math.sqrt(1.5))
    assert t_sf2(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert f_sf(4.0, 2, 10) == pytest.approx(0.0526, abs=5e-4) and t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert beta_cdf(0.5, 2, 2) == pytest.approx(0.5)
    assert stats.adjust([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    line = spark.createDataFrame([(float(i), 2.0 * i + 1 + (0.1 if i % 2 else -0.1)) for i in range(20)], "x double, y double")
    got = {r.term: r for r in stats.ols(line, "y", ["x"]).collect()}
    assert got["x"].coefficient == pytest.approx(2, abs=0.01) and got["x"].p < 1e-9
    km = stats.kaplan_meier(spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1)], "t int, e int"), "t", "e").orderBy("time").collect()
    assert [r.survival for r in km] == pytest.approx([0.75, 0.5, 0.0])
    with pytest.raises(Rejected):
        stats.sample(df, "x", 100)
    arms = stats.assign(spark.range(2000), "id", {"a": 1, "b": 1})
    assert 900 < arms.filter("arm = 'a'").count() < 1100
    b = stats.bootstrap(spark.range(500).selectExpr("id", "CAST(id AS DOUBLE) v"), "id", "v", 60).first()
    assert b.low < b["mean"] == 249.5 < b.high
    assert stats.power_mean(1, 1) == 16


def test_series_and_monitoring(spark):
    s = spark.createDataFrame([(dt.datetime(2026, 1, d), float(d % 3)) for d in (1, 2, 4, 5)], "t timestamp, v double")
    assert timeseries.gaps(s, "t", "D").count() == 1
    with pytest.raises(Rejected):
        timeseries.normalise(s, "t", "v", "D")
    level = spark.createDataFrame([("a", i, 1.0 if i < 5 else 9.0) for i in range(10)], "g string, t int, v double")
    c = timeseries.change_point(level, "t", "v", ["g"]).first()
    assert (c.change_at, c.before, c.after) == (5, 1.0, 9.0)
    assert timeseries.smooth(level, "t", "v", 0.5, ["g"]).count() == 10
    a, b = spark.range(100).selectExpr("id / 100.0 AS x"), spark.range(100).selectExpr("10 + id / 100.0 AS x")
    assert monitor.ks(a, b, "x").first()[0] == 1.0 and monitor.wasserstein(a, b, "x").first()[0] == pytest.approx(10) and monitor.psi(a, b, "x").first()[0] > 1
    assert monitor.psi(a, a, "x").first()[0] == pytest.approx(0)
    cats = monitor.category_drift(spark.createDataFrame([("A",), ("B",)], "c string"), spark.createDataFrame([("C",)], "c string"), "c").first()
    assert cats.js_distance == pytest.approx(1) and cats.unseen == 1
    m = monitor.binary_metrics(spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "y int, s double"), "y", "s").first()
    assert (m.tp, m.fp, m.fn, m.tn, m.roc_auc) == (1, 1, 1, 1, 0.75)


def test_text_and_privacy(spark):
    df = spark.createDataFrame([(1, "Red apple, RED pear"), (2, None), (3, "green apple")], "id int, t string")
    assert rows(text.term_counts(df, "id", "t").filter("term = 'red'")) == [(1, "red", 2)]
    w = text.tfidf(df, "id", "t")
    assert w.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    assert text.similar(w).first().cosine > 0
    out = privacy.project(df, {"id": "keep", "t": "pseudonym"}, "k").collect()
    assert out[1].column_2 is None and len(out[0].column_2) == 64
    assert privacy.project(df, {"id": "drop"}).columns == ["column_1"]


def test_windows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0)], "o int, v double")
    assert rows(windows.average_rank(df, "v"), "o", "rank") == [(1, 1.5), (2, 1.5), (3, 3.0)]
    wf = spark.createDataFrame([(1, "start", 10.0), (2, "change", -4.0), (3, "end", 6.0)], "o int, k string, a double")
    assert [r.total for r in windows.waterfall(wf, "o", "k", "a").orderBy("o").collect()] == [10.0, 6.0, 6.0]
    with pytest.raises(Rejected):
        windows.waterfall(wf.filter("o <> 2"), "o", "k", "a")
    assert rows(windows.systematic_sample(spark.range(10).withColumnRenamed("id", "o"), "o", 3)) == [(0,), (3,), (6,)]


def test_stream_and_its_twin_agree(spark, tmp_path):
    data = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(30)]
    df = spark.createDataFrame(data, "id int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.drain(streams.tumbling(stream, "ts", "1 day", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    want = rows(streams.tumbling_twin(df, "ts", "id", "1 day", "1 hour").filter("closed"), "window_start", "window_end", "n")
    assert got == want and len(got) > 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,d,b\n0007,1,2024-01-02,evet\n0008,x,2024-02-30,hayır\n0009,NA,2024-03-01,true\n", encoding="utf-8")
    raw = readers.delimited(spark, str(tmp_path / "a.csv"))
    assert readers.infer(raw.filter("id <> '0008'")) == {"id": "text", "n": "boolean", "d": "date", "b": "boolean"}
    good, bad = readers.typed(raw, {"n": "int64", "d": "date", "b": "boolean"}, "quarantine")
    assert rows(good, "id", "n", "b") == [("0007", 1, True), ("0009", None, True)] and bad.first().bad_columns == ["n", "d"]
    with pytest.raises(Rejected):
        readers.typed(raw, {"n": "int64"})
    nested = spark.createDataFrame([((1, [1, 2]), []), ((2, None), [5])], "a struct<x: int, y: array<int>>, l array<int>")
    flat = readers.flatten(nested)
    assert flat.columns == ["/a/x", "/a/y", "l"] and readers.expand_lists(flat, ["/a/y", "l"]).count() == 3
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, str(i)) for i in range(50)])
    assert readers.sqlite(spark, str(tmp_path / "d.db"), "t").agg(F.sum("a")).first()[0] == 1225
    (tmp_path / "f.fwf").write_text("001Çağrı  \n002Işıl   \n", encoding="utf-8")
    assert rows(readers.fixed_width(spark, str(tmp_path / "f.fwf"), {"id": (0, 3), "n": (3, 5)})) == [("001", "Çağrı"), ("002", "Işıl ")]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" t="inlineStr"><is><t>v</t></is></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert rows(readers.workbook(spark, str(tmp_path / "w.xlsx"))) == [(None, "5")]
    danger = spark.createDataFrame([("=1+1",), (None,)], "c string")
    assert rows(sinks.escaped(danger)) == [("'=1+1",), ("\\N",)]
    assert sinks.publish(danger, str(tmp_path), "v1").count() == 2


def test_workflows(spark):
    df = spark.createDataFrame([(1, " a "), (2, None)], "k int, s string")
    out = registry.run({"t": {"op": "cleaning.trim", "inputs": ["in"], "params": {"column": "s"}}, "d": {"op": "cleaning.drop_missing_rows", "inputs": ["t"], "params": {"columns": ["s"]}}}, {"in": df})
    assert rows(out["d"]) == [(1, "a")]
    with pytest.raises(Rejected):
        registry.run({"a": {"op": "cleaning.trim", "inputs": ["b"]}, "b": {"op": "cleaning.trim", "inputs": ["a"]}}, {})
    assert rows(registry.replay([{"op": "cleaning.trim", "params": {"column": "s"}}], df.withColumnRenamed("s", "q"), {"s": "q"})) == [(1, "a"), (2, None)]

    @registry.register("tests.twice", "transform")
    def twice(d):
        return d.union(d)

    assert registry.find("tests.twice")(df).count() == 4

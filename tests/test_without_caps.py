"""Cases beyond bounds that operators once had, and sources held against what was written."""

import io
import math
import sqlite3
import unicodedata
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.distributions import NORMAL, normal_cdf, normal_quantile, t_quantile
from lodestrata.functions.values import Rejected
from lodestrata.operators import charts, monitor, relational, sets, stats, windows
from lodestrata.operators.running import quantiles, running, with_next
from lodestrata.sources import readers


def test_running_sums_and_next_values_over_ranges(spark):
    values = [(i * 37 % 500, i) for i in range(500)]
    df = spark.createDataFrame(values, "v int, w int").repartition(4)
    got = {r.v: (r.s, r.n) for r in running(with_next(df, F.col("v"), "n"), [F.col("v")], {"s": F.col("w")}).collect()}
    total = 0
    for v, w in sorted(values):
        total += w
        assert got[v] == (total, v + 1 if v < 499 else None)
    assert running(df.limit(0), [F.col("v")], {"s": F.col("w")}).count() == 0


def test_normal_quantile_and_distribution(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NORMAL.inv_cdf(r.p), rel=1e-9, abs=1e-12)
    zs = spark.createDataFrame([(z / 4,) for z in range(-32, 33)], "z double")
    for r in zs.select("z", normal_cdf(F.col("z")).alias("c")).collect():
        assert r.c == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-9)


def test_flows_and_trees_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(40)], "s string, t string, w double")
    got = {r.node: r.level for r in charts.flow_levels(chain, "s", "t", "w").collect()}
    assert got == {f"n{i}": i for i in range(41)}
    with pytest.raises(Rejected):
        charts.flow_levels(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 0.0)], "s string, t string, w double"), "s", "t", "w")
    tree = spark.createDataFrame([(i, None if i == 0 else i - 1, 1.0 if i == 12 else 0.0) for i in range(13)], "n int, p int, v double")
    assert {r.node: (r.depth, r.total) for r in charts.tree(tree, "n", "p", "v").collect()} == {i: (i, 1.0) for i in range(13)}


def test_error_bars_keep_every_group(spark):
    df = spark.createDataFrame([(g, float(i % 7)) for g in range(2, 40) for i in range(g)], "g int, v double")
    got = {r.category: r for r in charts.error_bars(df, "g", "v", "ci").collect()}
    assert set(got) == set(range(2, 40))
    for g, r in got.items():
        sd = df.filter(F.col("g") == g).agg(F.stddev_samp("v")).first()[0] if g in (2, 39) else None
        assert sd is None or r.half == pytest.approx(t_quantile(0.975, g - 1) * sd / math.sqrt(g))


def test_ranks_within_groups_and_tests_of_two_groups(spark):
    rows = [(g, v) for g, vs in {"a": [3, 1, 3, 2], "b": [5], None: [1, 1]}.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v int")
    got = Counter((r.g, r.v, float(r.r)) for r in windows.average_rank(df, "v", "r", ["g"]).filter("g is not null").collect())
    assert got == Counter([("a", 3, 3.5), ("a", 3, 3.5), ("a", 2, 2.0), ("a", 1, 1.0), ("b", 5, 1.0)])
    with pytest.raises(Rejected):
        stats.mann_whitney(df.unionByName(df.withColumn("g", F.lit("c"))), "v", "g")


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert monitor.binary_metrics(df, "y", "s").first().roc_auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)


def test_ods_repeats_are_whole(spark, tmp_path):
    names = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0"'
    cell = lambda v, n=1: f'<table:table-cell table:number-columns-repeated="{n}">' + (f"<text:p>{v}</text:p>" if v else "") + "</table:table-cell>"
    body = f"<table:table-row>{cell('a', 300)}</table:table-row>" + f'<table:table-row table:number-rows-repeated="3">{cell("x", 299)}{cell("y")}{cell("", 16000)}</table:table-row>' + f'<table:table-row table:number-rows-repeated="2">{cell("", 16384)}</table:table-row>' + f"<table:table-row>{cell('', 2)}{cell('z')}</table:table-row>" + f'<table:table-row table:number-rows-repeated="1000000">{cell("", 16384)}</table:table-row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f"<office:x {names}><table:table>{body}</table:table></office:x>")
    rows = list(readers.ods_rows(out.getvalue()))
    assert rows == [["a"] * 300, *[["x"] * 299 + ["y"]] * 3, [], [], [None, None, "z"]]


def test_sqlite_reads_every_row(spark, tmp_path):
    at = str(tmp_path / "t.db")
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"v{k}") for k in range(-50, 50, 3)])
        db.execute("CREATE TABLE w (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        db.execute("INSERT INTO w VALUES ('a', 1)")
        db.execute("CREATE TABLE e (k INTEGER)")
    assert sorted(r.k for r in readers.sqlite(spark, at, "t").collect()) == list(range(-50, 50, 3))
    assert readers.sqlite(spark, at, "t", ["v"], "k < 0").columns == ["v"]
    assert [tuple(r) for r in readers.sqlite(spark, at, "w").collect()] == [("a", 1)] and readers.sqlite(spark, at, "e").count() == 0


def test_delimited_rows_are_good_or_in_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('note\na,b,c\r\n1,"x, ""y""",\r\n\r\n2,3\r\n4,5,6,7\r\n8,"open,9\r\n'.encode("cp1254") + "ş,ğ,İ\n".encode("cp1254"))
    good, bad = readers.quarantined(spark, str(tmp_path / "a.csv"), encoding="cp1254", header_row=1)
    assert sorted(tuple(r) for r in good.collect()) == [("1", 'x, "y"', ""), ("ş", "ğ", "İ")]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [("2,3", "short"), ("4,5,6,7", "long"), ('8,"open,9', "open quote")]


def test_json_lines_are_in_one_of_two_places(spark, tmp_path):
    lines = ['{"a": 1}', '{"a": "x", "b": [1]}', '{"a": 1', "nonsense", "[1, 2]", '{"b": null}', ""]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    for schema in (None, "a string, b array<bigint>"):
        good, bad = readers.json_lines(spark, str(tmp_path / "t.jsonl"), schema)
        assert good.count() + bad.count() == 6 and {r.value for r in bad.collect()} >= {'{"a": 1', "nonsense"}


def test_as_of_with_ties_nulls_and_a_hot_key(spark):
    left = [(1, t, i) for i, t in enumerate([5, 1, 9, 9, None])] + [(None, 3, 7), (2, 4, 8)] + [(3, t, 100 + t) for t in range(2000)]
    right = [(1, 5, "a"), (1, 5, "b"), (1, 8, None), (2, 9, "z"), (3, 10, "k"), (None, 1, "n")]
    got = {r.i: r.v for r in sets.as_of(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, v string"), ["k"], "t", ["v"]).collect()}
    assert got == {0: "b", 1: None, 2: None, 3: None, 4: None, 7: None, 8: None} | {100 + t: "k" if t >= 10 else None for t in range(2000)}


def test_quantiles_of_many_values(spark):
    values = [float(i * 7919 % 1000) for i in range(777)] + [5.0] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in shares]))).first()[0]
    assert quantiles(df, F.col("v"), shares) == pytest.approx(want) and quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


def test_block_pairs_by_matching_blocks(spark):
    names = ["Straße 12", "STRASSE 12", "strasse  13", "ﬁne paper", "fine papers", "", "zzz", None]
    df = spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(names)] + [(10 + i, 0, n) for i, n in enumerate(names)], "k int, b int, t string")
    fold = lambda s: unicodedata.normalize("NFKC", s).casefold().strip()
    rows = [r for r in df.collect() if r.t is not None]
    want = {(x.k, y.k): SequenceMatcher(None, fold(x.t), fold(y.t), autojunk=False).ratio() for x in rows for y in rows if x.k < y.k and x.b == y.b}
    got = {(r.left_id, r.right_id): r.similarity for r in relational.block_pairs(df, "k", ["b"], "t", 0.8, "ratio").collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.8}) and len(got) > 3


def test_differences_and_sets_refuse_what_they_cannot_tell(spark):
    df = spark.createDataFrame([(1, math.nan), (2, None)], "k int, v double")
    assert sets.difference(df, df, ["k"]).count() == 0
    with pytest.raises(Rejected):
        sets.difference(df.unionByName(df), df, ["k"])
    with pytest.raises(Rejected):
        sets.combine(df, df.select("k"), "union")


def test_survival_curves_of_groups(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 2, True), ("a", 5, True), ("b", 1, True), ("b", 1, True), ("c", 3, False), ("c", 4, True), ("c", 9, False)]
    got = {(r.g, r.time): (r.at_risk, r.events, r.survival) for r in stats.kaplan_meier(spark.createDataFrame(rows, "g string, t int, e boolean"), "t", "e", "g").collect()}
    want = {}
    for g in "abc":
        s = 1.0
        for t in sorted({t for h, t, e in rows if h == g and e}):
            n, d = sum(h == g and u >= t for h, u, _ in rows), sum(h == g and u == t and e for h, u, e in rows)
            s *= 1 - d / n
            want[g, t] = (n, d, s)
    assert got == {k: (n, d, pytest.approx(s, abs=1e-12)) for k, (n, d, s) in want.items()}

"""Work of queries on tables with many copies, heavy keys and many rows."""

from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from lodestrata.operators import relational, text
from pyspark.sql import functions as F


@pytest.mark.parametrize("method", ["distance", "ratio"])
def test_copies_are_compared_once(spark, monkeypatch, method):
    # Names of two blocks, each many times, with ids in an order of their own.
    names = ["red bolt 1", "red bolt 2", "Red Bolt 1 ", "blue rod", "blue rods", "", None]
    rows = [(i * 37 % 350, i % 2, names[i % 7]) for i in range(350)] + [(None, 0, "red bolt 1"), (9, None, "red bolt 1"), (11, None, "red bolt 2")]
    n = spark.sparkContext.accumulator(0)

    def distance(x, y):
        n.add(1)
        if x is None or y is None:
            return None
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    def ratio(x, y):
        n.add(1)
        return SequenceMatcher(None, x, y, autojunk=False).ratio()

    monkeypatch.setattr(relational.F, "levenshtein", F.udf(distance, "int"))
    monkeypatch.setattr(relational, "sequence_ratio", F.udf(ratio, "double"))
    got = sorted(tuple(r) for r in relational.block_pairs(spark.createDataFrame(rows, "k int, b int, t string"), "k", ["b"], "t", 0.8, method).collect())
    # Five texts a block, and two without one; the planner may take each ordered pair twice.
    assert n.value <= 2 * (2 * 25 + 4)
    like = {"distance": lambda s, t: 1 - distance(s, t) / max(len(s), len(t), 1), "ratio": ratio}[method]
    clean = [(k, b, t.strip().lower()) for k, b, t in rows if t is not None and k is not None]
    memo = {(s, t): like(s, t) for s in {r[2] for r in clean} for t in {r[2] for r in clean}}
    want = sorted((i, j, memo[s, t]) for i, b, s in clean for j, c, t in clean if i < j and b == c and memo[s, t] >= 0.8)
    assert got == [(i, j, pytest.approx(v)) for i, j, v in want] and len(got) > 5000


@pytest.mark.parametrize("threshold, most, texts", [(0.9, 0.1, 300), (0.8, 1.0, 60), (0.0, 1.0, 20)])
def test_ratio_compares_few_of_texts_that_differ(spark, monkeypatch, threshold, most, texts):
    monkeypatch.setattr(relational, "MEETING_TEXTS", 16, raising=False)
    # Names that all differ, of some lengths, and a few long and short ones; ids in an order of their own.
    names = [f"supplier#{i * 7919 % 100000:0{9 - (i % 9 == 4)}d}" for i in range(texts)] + ["", "a", "ab", "b" * 60, "b" * 58 + "cd", "c" + "b" * 59]
    rows = [(i * 101 % 997, int(i % 9 == 5) if i % 50 else None, s) for i, s in enumerate(names)]
    n = spark.sparkContext.accumulator(0)

    def ratio(x, y):
        n.add(1)
        return SequenceMatcher(None, x, y, autojunk=False).ratio()

    monkeypatch.setattr(relational, "sequence_ratio", F.udf(ratio, "double"))
    got = sorted(tuple(r) for r in relational.block_pairs(spark.createDataFrame(rows, "k int, b int, t string"), "k", ["b"], "t", threshold, "ratio").collect())
    pairs = [(i, j, SequenceMatcher(None, s, t, autojunk=False).ratio()) for i, b, s in rows for j, c, t in rows if i < j and b == c]
    assert got == sorted(p for p in pairs if p[2] >= threshold) and len(got) > 50
    # A text meets itself once, too.
    assert n.value <= most * len(pairs) + len(rows)


@pytest.mark.parametrize("nulls", [True, False])
def test_full_join_deals_out_heavy_keys(spark, monkeypatch, nulls):
    monkeypatch.setattr(relational, "KEY_ROWS", 100, raising=False)
    # A key of 60 times 50 rows that is null, one of 3 times 400, one of 200 times 1, light ones, and some without partners.
    a = [(None, i) for i in range(60)] + [(1, i) for i in range(3)] + [(2, i) for i in range(200)] + [(k, 0) for k in (3, 3, 4, 5)]
    b = [(None, i) for i in range(50)] + [(1, i) for i in range(400)] + [(2, 0)] + [(k, i) for k in (3, 4, 6) for i in range(2)]
    hit = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and (nulls or x[0] is not None)]
    want = [a[i] + b[j] for i, j in hit]
    want += [a[i] + (None, None) for i in set(range(len(a))) - {i for i, _ in hit}] + [(None, None) + b[j] for j in set(range(len(b))) - {j for _, j in hit}]
    left, right = spark.createDataFrame(a, "ak int, av int"), spark.createDataFrame(b, "bk int, bv int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = relational.join(left, right, [("ak", "bk")], "full", nulls)
        rows = joined.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter(tuple(r)[:4] for r in rows) == Counter(want)
    heavy = Counter(r.p for r in rows if (r.ak is None and r.bk is None and r.av is not None and r.bv is not None) or r.ak == 1)
    assert len(heavy) > 2 and max(heavy.values()) < 0.6 * sum(heavy.values())


def test_copies_are_no_pairs_before_the_closest(spark, monkeypatch):
    # Copies of four texts, one of them twice as long, and texts that differ in a word; few terms, in many documents each.
    kinds = ["a b c d", "a b c d a b c d", "a b b e", "c d e e f"]
    docs = [(i * 11 % 240, kinds[i % 4] if i < 160 else f"a b c w{i} w{i % 7}") for i in range(240)]
    weights = text.tfidf(spark.createDataFrame(docs, "id bigint, t string"), "id", "t").cache()
    by = defaultdict(dict)
    for r in weights.collect():
        by[r.doc][r.term] = r.weight
    every = sorted((-round(sum(w * by[j].get(t, 0) for t, w in by[i].items()), 12), i, j) for i, j in combinations(sorted(by), 2) if set(by[i]) & set(by[j]))
    met, plain = [], text._meeting

    def counted(*args):
        met.append(plain(*args))
        return met[-1]

    monkeypatch.setattr(text, "_meeting", counted)
    for limit in (30, 3500):
        got = [tuple(r) for r in text.similar(weights, limit).collect()]
        assert [c for _, _, c in got] == pytest.approx([-c for c, _, _ in every[:limit]])
        if limit == 30:
            assert [p[:2] for p in got] == [p[1:] for p in every[:30]]
    assert met[0].count() < 100

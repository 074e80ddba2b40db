"""Registered queries over whole tables, held against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest

from lodestrata.operators import text
from lodestrata.plans import queries

N = 1300


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def linked(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def hops(near, start):
    found, front, d = {start: 0.0}, {start}, 0.0
    while front:
        d += 1
        front = {n for f in front for n in near[f]} - set(found)
        found |= dict.fromkeys(front, d)
    return found


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    # Ids lie beyond the bounds 400 and 600, and orders have gaps, so that there are several components.
    at = str(tmp_path_factory.mktemp("whole"))
    made = {
        "orders": ("o_orderkey bigint, o_custkey bigint", [(k, k * 13 % 211) for k in range(N) if k % 100 > 5]),
        "customer": ("c_custkey bigint, c_name string", [(k, f"c{k}") for k in range(0, 260, 2)] + [(k, f"c{k}") for k in range(1, 200, 4)]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint", [(k, (k * 7 + j * 31) % 97 + 100 * (k % 40 == 3), k * j % 11) for k in range(N) for j in range(3)]),
        "part": ("p_partkey bigint, p_name string, p_brand string", [(k, ["old ring", "old rings", "hot bolt", "blue plate"][k % 4], f"b{k % 3}") for k in range(380, 460)]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at, {k: v[1] for k, v in made.items()}


def got(spark, tables, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, tables[0]).collect()]


def test_graphs_of_all_rows(spark, tables):
    orders, lines = tables[1]["orders"], tables[1]["lineitem"]
    ends = Counter(), Counter()
    for o, _, s in lines:
        ends[1][o] += 1
        ends[0][-1 - s] += 1
    want = {n: (ends[0][n], ends[1][n], ends[0][n] + ends[1][n]) for n in ends[0] | ends[1]}
    assert {r[0]: r[1:] for r in got(spark, tables, "degree")} == want
    near = linked((k, k - 1 - k % 3) for k, _ in orders)
    want = {n: min(hops(near, n)) for n in list(near)}
    assert dict(got(spark, tables, "components")) == want and len(set(want.values())) > 5
    near = linked((o, -1 - p) for o, p, _ in lines)
    assert dict(got(spark, tables, "shortest_paths")) == hops(near, 0)


def test_joins_of_all_rows(spark, tables):
    c = [(None if k % 7 == 0 else k, n) for k, n in tables[1]["customer"]]
    o = [(None if k % 1000 == 0 else ck, k) for k, ck in tables[1]["orders"]]
    for how in ("inner", "left", "right", "full"):
        for null in (False, True):
            hit = [(i, j) for i, x in enumerate(c) for j, y in enumerate(o) if x[0] == y[0] and (null or x[0] is not None)]
            want = [c[i] + o[j] for i, j in hit]
            if how in ("left", "full"):
                want += [c[i] + (None, None) for i in set(range(len(c))) - {i for i, _ in hit}]
            if how in ("right", "full"):
                want += [(None, None) + o[j] for j in set(range(len(o))) - {j for _, j in hit}]
            assert Counter(got(spark, tables, f"join_{how}{'_null_equal' * null}")) == Counter(want)
    keys, n = {k for k, _ in tables[1]["customer"]}, Counter(ck for _, ck in tables[1]["orders"])
    inner, lu, ru = sum(v for k, v in n.items() if k in keys), sum(v for k, v in n.items() if k not in keys), len(keys - set(n))
    assert got(spark, tables, "join_preflight") == [(inner, lu, ru, inner + lu, inner + ru, inner + lu + ru, "n:1")]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_closest_of_all_pairs_of_documents(spark, most):
    # Terms lie in many documents, and few pairs share a rare one.
    docs = [(i, " ".join(f"{'abcdefgh'[(i * k * k + k) % 8]}{'xyz'[(i // 3 + k) % 3]}" for k in range(3 + i % 9)) + (" rare" if i % 17 == 0 else "")) for i in range(70)]
    weights = text.tfidf(spark.createDataFrame(docs, "id bigint, t string"), "id", "t").cache()
    by = defaultdict(dict)
    for r in weights.collect():
        by[r.doc][r.term] = r.weight
    all_pairs = {(a, b): sum(w * by[b][t] for t, w in by[a].items() if t in by[b]) for a, b in combinations(sorted(by), 2) if set(by[a]) & set(by[b])}
    want = sorted(((-round(c, 9), p) for p, c in all_pairs.items()))[:30]
    found = [(r.a, r.b, r.cosine) for r in text.similar(weights, 30, most).collect()]
    assert [c for _, _, c in found] == pytest.approx([-c for c, _ in want]) and all(all_pairs[a, b] == pytest.approx(c) for a, b, c in found)
    assert len({(a, b) for a, b, _ in found}) == 30


def test_similar_docs_is_registered(spark, tmp_path):
    spark.createDataFrame([(1, "one two three"), (2, "one two four"), (3, "five")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r)[:2] for r in queries.QUERIES["similar_docs"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_pairs_of_all_parts(spark, tables):
    rows = [(k, b, f"{t}{k % 10}") for k, t, b in tables[1]["part"]]
    want = {}
    for (i, b, x), (j, c, y) in combinations(rows, 2):
        if b == c and (s := 1 - distance(x, y) / max(len(x), len(y))) >= 0.8:
            want[i, j] = s
    assert {r[:2]: r[2] for r in got(spark, tables, "block_pairs")} == pytest.approx(want) and max(want)[1] >= 400

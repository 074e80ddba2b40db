"""Operators on documents, held against brute force on small fixtures."""

import hashlib
import itertools
import math
import random
import re
import time
import weakref
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, mixing, ngram_join, quality, sharding, toxicity
from lodestrata.llm.common import release, row_digest
from lodestrata.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "naïve", "x-y", "a1"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 120))) for _ in range(n)]
    rows = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(base)]
    for k in range(12):
        words = base[k % 5].split()
        if k % 3:
            words[rng.randrange(len(words))] = "edited"
        rows.append((len(rows), " ".join(words), "s0"))
    rows += [(900, None, "s1"), (901, "", None), (902, "   ", "s2"), (903, "one two", "s0"), (904, "ONE two", "s0"), (905, "w1 " * 30_000, "s3"), (905, "w1 " * 30_000, "s3")]
    return rows


# --- 10: n-gram Jaccard join


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i)) for i in sets}


def test_ngram_join_matches_brute_force(spark):
    rows = corpus()
    got = ngram_join.near_duplicates(make(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_components(rows)


def test_ngram_join_chain_across_leaders(spark):
    # Neighbours in a chain link, its ends don't: only links count, not the distance to a leader.
    words = [f"t{i}" for i in range(80)]
    rows = []
    for k in range(8):
        words = words[:]
        words[8 * k + 4] = f"n{k}"
        rows.append((50 - k, " ".join(words), "s"))
    assert {tuple(r) for r in ngram_join.near_duplicates(make(spark, rows)).collect()} == brute_components(rows)


@pytest.mark.parametrize("block", [4096, 150])
def test_ngram_join_of_one_template_in_many_components(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rng = random.Random(8)
    template = [f"t{i}" for i in range(70)]
    rows = []
    for k in range(2000):
        w = template[:]
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
            w[rng.randrange(70)] = f"e{rng.randrange(60)}"
        rows.append((3000 - k, " ".join(w), "s"))
    want = brute_components(rows)
    assert {tuple(r) for r in ngram_join.near_duplicates(make(spark, rows)).collect()} == want
    assert len({c for _, _, c in want}) > 20


def test_ngram_join_of_texts_under_one_key_and_null_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "s"), (5, b, "s"), (7, a + " x", "s"), (3, b + " y", "s"), (None, a + " z", "s"), (None, None, "s"), (None, "alone " * 9, "s")]
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(make(spark, rows)).collect())
    assert got == Counter([(5, 36, 5), (5, 36, 3), (7, 37, 5), (3, 37, 3), (None, 37, 5), (None, 0, None), (None, 1, None)])


def test_ngram_join_empty_and_extra_columns(spark):
    assert ngram_join.near_duplicates(make(spark, [])).count() == 0
    docs = make(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s")]).selectExpr("*", "1 AS n", "'k' AS key", "0 AS rep")
    assert {tuple(r) for r in ngram_join.near_duplicates(docs).collect()} == {(1, 2, 1), (2, 2, 1)}


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# --- 1: decontamination


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = word.findall((text or "").translate(low))
    hit, names = set(), set()
    for name, t in items:
        it = word.findall((t or "").translate(low))
        for i in range(max(1, len(it) - 9)) if it else ():
            win = it[i : i + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    names.add(name)
    return len(w), len(hit), sorted(names)


ITEMS = [("7", "w1 W2, w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("12", "Été naïve"), ("3", None), ("4", " .. "), ("5", "w1 w1 w1"), ("6", "w1 w1 w1")]


@pytest.mark.parametrize("block,vocabulary", [(1_000_000, 1_000_000), (5, 1_000_000), (1_000_000, 2)])
def test_decontamination_matches_brute_force(spark, monkeypatch, block, vocabulary):
    monkeypatch.setattr(decontamination, "MAX_VOCABULARY", vocabulary)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (block,))
    rows = [*corpus()[:20], (100, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 y ÉTÉ été naïve Été NAÏVE", "s"), (101, None, "s"), (102, "w1 " * 5000, None), (102, "w1 " * 5000, None)]
    bench = spark.createDataFrame([(int(n), t) for n, t in ITEMS], "item_id bigint, text string")
    got = decontamination.decontaminate(make(spark, rows), bench).collect()
    want = [(i, *brute_hits(t, ITEMS)) for i, t, _ in rows]
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want)


def test_decontamination_without_items_or_documents(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in decontamination.decontaminate(make(spark, [(1, "a b", "s")]), bench).collect()] == [(1, 2, 0, [])]
    assert decontamination.decontaminate(make(spark, []), bench).count() == 0


def test_proximity_matches(spark):
    docs = make(spark, [(1, "alpha x beta y y y y y alpha", "s"), (2, "beta", "s"), (3, "beta alpha", "s")])
    index = decontamination.build_index(docs, "doc_id", "text")
    got = decontamination.proximity_matches(index, [("q", [b"alpha", b"beta"])], 4).collect()
    assert sorted(tuple(r) for r in got) == [(1, "q", 0, 3), (3, "q", 0, 2)]


# --- 3: mixing


def test_targets_are_filled_and_reshared(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 500), ("a", 0)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    caps, weights, total = {"a": 200, "b": 2000, "c": 2000, None: 1000}, {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * 2600
    want, free = {}, set(caps)
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= caps[s]}
        if not over:
            break
        want |= {s: float(caps[s]) for s in over}
        free -= over
    want |= {s: weights[s] * level for s in free}
    assert got == pytest.approx(want)


def brute_copies(rows, targets, offsets):
    """Copies of each (doc_id, size, source) in the order given, level by level, in plain Python."""
    out = {}
    for source, (size, target, rate) in targets.items():
        want, rest = target, size
        for level in range(4):
            own = [r for r in rows if r[2] == source and sum(r[1] <= size * x for x in mixing.LEVELS) == level]
            taken = 0
            for k, (i, n, _) in enumerate(own, 1):
                out[i] = math.floor(k * rate + offsets[source]) - math.floor((k - 1) * rate + offsets[source])
                taken += out[i] * n
            want, rest = want - taken, rest - sum(r[1] for r in own)
            rate = min(2.0, max(0.0, want / rest)) if rest > 0 else rate
    return out


def test_mix_takes_near_its_targets_and_agrees_with_itself(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.choice([rng.randint(1, 60), 60, 900]))), rng.choice(["s0", "s1", "s2"])) for i in range(3000)] + [(9000, None, "s0"), (9001, "", None), (9002, "w " * 9000, "s0")]
    docs = mixing.sized(make(spark, rows)).selectExpr("*", "'x' AS rate", "1 AS target", "2 AS source_size", "3 AS copies")
    first = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source").collect()]
    again = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source").collect()]
    assert sorted(first, key=str) == sorted(again, key=str) and len(first) == len(rows)
    taken, target = Counter(), {}
    for _, size, _, t, got, copies, source in first:
        assert got == copies * size and 0 <= copies <= 2
        taken[source] += got
        target[source] = t
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.001, abs=60)


def test_copies_match_brute_force(spark):
    rng = random.Random(6)
    # Sizes are all different, so that the order is that of sizes, from class to class downwards.
    rows = [(i, n, f"s{i % 3}") for i, n in enumerate(rng.sample(range(1, 3000), 400))] + [(1000, 60_000, "s0"), (1001, 31_000, "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    offsets = {r.source: r.u for r in df.select("source", mixing.hash_unit(F.lit("mix-1"), F.col("source")).alias("u")).distinct().collect()}
    targets = {r.source: (r.source_size, r.target, r.target / r.source_size) for r in got.values()}
    place = {r[0]: p for r, p in zip(rows, df.select(*mixing._block(F.lit(1)), "doc_id", F.xxhash64("doc_id").alias("x"), "size").collect(), strict=True)}
    ordered = sorted(rows, key=lambda r: (place[r[0]]["__class"], place[r[0]]["__salt"], r[1], place[r[0]].x))
    assert {i: r.copies for i, r in got.items()} == brute_copies(ordered, targets, offsets)
    for s, (_, target, _) in targets.items():
        assert sum(r.taken for r in got.values() if r.source == s) == pytest.approx(target, rel=0.003)


def test_emit_repeats_rows_as_often_as_taken(spark):
    rows = [(i, f"text {i} " * (i % 7), f"s{i % 2}") for i in range(200)] + [(7, "same", "s0")] * 3 + [(7, None, "s0")] * 2 + [(None, "same", None)]
    docs = make(spark, rows)
    mixed = mixing.mix(mixing.sized(docs.withColumn("__row", row_digest("doc_id", "text")))).cache()
    want = Counter()
    by_row = {bytes(r.k): (r.doc_id, r.text) for r in docs.select("doc_id", "text", row_digest("doc_id", "text").alias("k")).collect()}
    for r in mixed.collect():
        want[by_row[bytes(r["__row"])]] += r.copies
    got = Counter((r.doc_id, r.text) for r in mixing.emit(docs, mixed).collect())
    assert got == +want


def test_mix_of_nothing(spark):
    assert mixing.mix(mixing.sized(make(spark, []))).count() == 0


# --- 5: sharding


def test_shards_are_balanced_and_slots_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "z" * rng.randint(0, 400), "s") for i in range(3000)] + [(5000 + i, "hot text " * 20, "s") for i in range(1500)] + [(9000, None, "s"), (9000, None, "s")]
    got = sharding.assign(sharding.fingerprints(make(spark, rows)), 8).collect()
    assert len(got) == len(rows)
    slots, sizes = {}, Counter()
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
        assert r["size"] == 16 + len((r.text or "").encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 8 and min(sizes.values()) > 0.98 * sum(sizes.values()) / 8
    small = {}
    for r in got:
        if r.text and 0 < len(r.text) and not r.text.startswith("hot"):
            small.setdefault(r.text, set()).add(r.shard)
    assert all(len(v) == 1 for v in small.values())
    assert len({r.shard for r in got if r.text and r.text.startswith("hot")}) > 1  # too heavy for one shard
    for c in ("tokens", "size"):
        loads = Counter()
        for r in got:
            loads[r.shard] += r[c]
        assert max(loads.values()) < 1.05 * sum(loads.values()) / 8
    counts = [len(v) for v in slots.values()]
    assert max(counts) < 1.08 * len(rows) / 8 and min(counts) > 0.92 * len(rows) / 8
    assert sharding.assign(sharding.fingerprints(make(spark, []))).count() == 0


def test_groups_of_half_a_shard_and_more_stay_whole_and_many_shards_work(spark):
    rows = [(i, f"{i} filler words here", "s") for i in range(2000)] + [(5000 + i, "kept whole", "s") for i in range(190)]
    extra = sharding.fingerprints(make(spark, rows)).selectExpr("*", "1 AS __n", "2 AS share", "3 AS start")
    got = sharding.assign(extra, 10).collect()
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1 and len(got) == len(rows) and got[0].share == 2
    many = sharding.assign(sharding.fingerprints(make(spark, rows)), 700).collect()
    assert len(many) == len(rows) and max(r.shard for r in many) < 700 and len({(r.shard, r.slot) for r in many}) == len(rows)


def test_pack_matches_brute_force():
    rng = random.Random(3)
    vectors = [[rng.randint(1, 50), rng.randint(1, 9), 1] for _ in range(60)]
    total = [sum(v[k] for v in vectors) for k in range(3)]
    share = [[v[k] * 4 / total[k] for k in range(3)] for v in vectors]
    left, want = [[1.0] * 3 for _ in range(4)], [0] * 60
    for i in sorted(range(60), key=lambda i: (-max(share[i]), i)):
        dots = [sum(w * s * r for w, s, r in zip(sharding.WEIGHTS, share[i], left[j])) for j in range(4)]
        want[i] = max(range(4), key=lambda j: (round(dots[j], 12), -j))
        left[want[i]] = [a - b for a, b in zip(left[want[i]], share[i])]
    assert sharding.pack(np.array(vectors, float), 4).tolist() == want


def test_pack_prefers_room_in_the_needed_dimension():
    vectors = np.array([[10, 1, 1], [1, 10, 1], [10, 1, 1], [1, 10, 1]], dtype=float)
    chosen = sharding.pack(vectors, 2)
    loads = np.array([vectors[chosen == s].sum(axis=0) for s in (0, 1)])
    assert np.ptp(loads, axis=0).tolist() == [0, 0, 0]


def test_release_gives_back_what_the_jvm_freed_outside_its_heap(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", status.read_text())[1]) / 1024
    jvm.System.gc()
    # Each has some 256 KB of its own; a few that stay keep the rest from going by itself.
    made = [jvm.java.util.zip.Deflater() for _ in range(400)]
    for i, x in enumerate(made):
        if i % 40 != 39:
            x.end()
    jvm.System.gc()
    before = held()
    release(spark)
    after = held()
    for x in made:
        x.end()
    assert after < before - 50


def test_near_duplicates_hold_no_tables_of_bits_on_the_driver(spark, monkeypatch):
    made, alive, plain, pairs = [], [], ngram_join.bit_table, ngram_join.open_pairs

    def noted(*args):
        table = plain(*args)
        made.append(weakref.ref(table))
        return table

    def counted(*args):
        alive.append(sum(x() is not None for x in made))
        return pairs(*args)

    monkeypatch.setattr(ngram_join, "bit_table", noted)
    monkeypatch.setattr(ngram_join, "open_pairs", counted)
    rows = corpus(4)
    got = ngram_join.near_duplicates(make(spark, rows)).select("doc_id", "component_id").collect()
    assert {tuple(r) for r in got} == {(i, c) for i, _, c in brute_components(rows)}
    assert len(made) >= 4 and alive == [0]


def test_near_duplicates_keep_no_prefixes(spark, monkeypatch):
    # Written tables of prefixes and segments take the most disk, and go once they have been read.
    written, plain = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: (written.append(plain(df, name)), written[-1])[1])
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 40 + i % 3]), "s") for i in range(12)] + [(20, " ".join(words[::-1]), "s"), (21, None, "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(spark, rows)).collect()}
    assert got == {i: (36 + i % 3, 0) for i in range(12)} | {20: (56, 20), 21: (0, 21)}
    wide = [df for df in written if {"prefix", "segment"} & set(df.columns)]
    assert len(wide) >= 3 and not any(Path(df._written_to.removeprefix("file:")).exists() for df in wide)


def test_near_duplicates_write_prefixes_of_lone_rows_once(spark, monkeypatch):
    # Only rows of sets that several rows have are grouped, so prefixes of the others are neither shuffled nor written again.
    rows_of, plain = {}, ngram_join.materialize

    def spy(df, name):
        out = plain(df, name)
        if "prefix" in out.columns:
            rows_of[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", spy)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "s") for i in range(40)] + [(50 + i, " ".join(f"w{i}x{k}" for k in range(30)), "s") for i in range(3)]
    got = {tuple(r) for r in ngram_join.near_duplicates(make(spark, rows)).collect()}
    assert got == {(i, 26, i) for i in range(40)} | {(50 + i, 26, i) for i in range(3)}
    assert rows_of == {"sets": 43, "classes": 3}


def test_near_duplicates_cut_segments_once_and_know_their_sides(spark, monkeypatch):
    tables, plain = {}, ngram_join.materialize

    def spy(df, name):
        out = plain(df, name)
        if name in ("pairs", "segments") and name not in tables:
            tables[name] = out.collect()
        return out

    monkeypatch.setattr(ngram_join, "materialize", spy)
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(60 + i % 2)), "s") for i in range(12)]
    got = {tuple(r) for r in ngram_join.near_duplicates(make(spark, rows)).collect()}
    assert got == {(i, 56 + i % 2, i - i % 2) for i in range(12)}
    pairs, found = tables["pairs"], tables["segments"]
    assert len(pairs) == 6 and len(found) == 12 * ngram_join.FRAGMENTS
    assert {r.rep for r in found if r.as_a} == {p.a for p in pairs} and {r.rep for r in found if r.as_b} == {p.b for p in pairs}


@pytest.mark.parametrize("block", [4096, 20])
def test_near_duplicates_with_bits_that_are_all_set(spark, monkeypatch, block):
    # Tables of bits may let anything through: the result doesn't depend on them.
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rng = random.Random(4)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(600)), "s") for i in range(150)]
    for k in range(120):
        w = template[:]
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(60)] = f"e{rng.randrange(30)}"
        rows.append((200 + k, " ".join(w), "s"))
    rows += [(900 + k, rows[k][1], "s") for k in range(5)] + [(950, None, "s"), rows[160]]
    want = brute_components(rows)
    got = ngram_join.near_duplicates(make(spark, rows)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


# --- 9: quality


def test_quality_learns_a_preference(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["tree", "house", "river", "walks", "slowly", "under"]) + str(rng.randint(0, 99)) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW"]) + "!!" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(300)]
    docs = make(spark, [*rows, (400, None, "s"), (401, "", "s"), (402, "a " * 100_000, "s")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(300)] + [(None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels, "quality", 1, 3)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(300))
    assert len(got) == 303 and all(0 <= v <= 1 for v in got.values())


def test_quality_without_labels(spark):
    docs = make(spark, [(1, "x", "s")])
    model = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"), "quality", 1, 3)
    assert quality.score(docs, model).first().score >= 0.5


def test_quality_fits_on_all_labelled_rows(spark, monkeypatch):
    # Fewer rows or pairs than these were read before; the fit is held against the loss of all pairs.
    rng = random.Random(5)
    text = lambda good, i: " ".join(rng.choice(["tree", "house", "7", "42"] if good ^ (rng.random() < 0.2) else ["tree", "house", "BUY!"]) for _ in range(12))
    rows = [(i, text(i % 3 > 0, i), "s") for i in range(600)]
    docs, labels = make(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "TRAIN_ROWS", 50, raising=False)
    monkeypatch.setattr(quality, "PAIRS", 100, raising=False)
    model = quality.train(docs, labels, "quality", 1, 3)
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    x, y = np.array([quality.features(r[1].encode()) for r in used]), np.array([r[0] % 3 > 0 for r in used])
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), -8, 8)
    # The loss of all pairs is flat at the weights, and the threshold is the worth at the rank of the bad rows.
    diff = (z[y][:, None] - z[~y][None]).reshape(-1, z.shape[1])
    slope = lambda w: (diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) - 1e-3 * w
    assert np.abs(slope(model.w)).max() < 5e-5 < 5e-4 < np.abs(slope(model.w * 0.95)).max()
    order = np.sort(z @ model.w)
    assert model.threshold == pytest.approx((order[(~y).sum() - 1] + order[(~y).sum()]) / 2)
    same = quality.fit(x, y.astype(int))
    assert model.w == pytest.approx(same.w, abs=1e-9) and (model.threshold, model.width) == pytest.approx((same.threshold, same.width))


# --- 7: toxicity


def test_restore_undoes_disguises(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["idiot", "loser", "the", "moron", "and", "stupid", "house", "clown", "pathetic"]) for _ in range(400))
    logp = toxicity.character_model(make(spark, [(i, text, "s") for i in range(50)] + [(99, None, "s")])).tolist()
    for seen, meant in (("1d10t", "idiot"), ("l0s3r", "loser"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("s-t-u-p-i-d", "stupid"), ("p@thet1c", "pathetic"), ("c l o w n", "clown"), ("the", "the")):
        assert toxicity.restore(seen, logp) == meant


def test_every_disguise_reaches_the_lattice(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["idiot", "loser", "the", "moron", "and", "stupid", "house", "clown", "hello"]) for _ in range(400))
    f = toxicity.Features(toxicity.character_model(make(spark, [(i, text, "s") for i in range(50)])))
    for meant, disguises in {
        "idiot": ["1 d 1 0 t", "i d 1 o t", "iddioot", "i  d  i  o  t", "i,d,i,o,t", "1.d.1.0.t"],
        "moron": ["m.0.r.0.n", "m-0-r-0-n", "m..o..r..o..n"],
        "stupid": ["stuupidd", "s/t/u/p/i/d", "s t u p 1 d", "$ t u p i d", "s`t`u`p`i`d", "s\\t\\u\\p\\i\\d"],
    }.items():
        for seen in disguises:
            assert set(f.word(meant)) <= set(f.of_text(f"the house {seen} and")), seen
    assert f.restored("hello") == "hello" and f.restored("2024-1-5") == "2024-1-5"
    assert f.of_text("1 2 3 4") == sorted({i for w in "1234" for i in f.word(w)})
    assert f.of_text("* " * 20_000 + "*" * 20_000) is not None


def test_restore_matches_brute_force():
    rng = np.random.default_rng(5)
    logp = np.log(rng.dirichlet(np.ones(toxicity.CLASSES) / 4, toxicity.CLASSES**2) + 1e-9).ravel().tolist()
    for token in ("1d10t", "a-b-c", "baa", "$tuu", "l**r", "aaab", "0_0", "x", "é1l", "a b"):
        best = (-math.inf, "")
        for path in itertools.product(*toxicity.lattice(token)):
            sent, score, a, b = "".join(x for x, _ in path), sum(c for _, c in path), 0, 0
            for c in sent + " ":
                k = toxicity.class_of(c) if c != " " or len(sent) else 0
                score += logp[(a * toxicity.CLASSES + b) * toxicity.CLASSES + k]
                a, b = b, k
            best = max(best, (score, sent))
        assert toxicity.restore(token, logp) == best[1], token


@pytest.mark.parametrize("text", ["1" + "." * 100_000 + "12", "!" * 100_000 + "a", "$" * 100_000 + "a", "a" + "$" * 100_000, "$.$.!" * 20_000 + "a", "a" * 100_000, "a." * 50_000, "a-b " * 30_000, "1a" * 50_000, "'\"|" * 30_000])
def test_hostile_tokens_take_linear_time(text):
    f = toxicity.Features(np.full(toxicity.CLASSES**3, -3.0, np.float32))
    began = time.time()
    f.of_text(text)
    assert time.time() - began < 20


def test_trailing_signs_go():
    assert [toxicity.without_trailing(t) for t in ("a!?", "a$$$.", "a$$", "cash$$$$|", "...", "$$$")] == ["a", "a", "a$$", "cash", "", ""]


def test_toxicity_finds_disguised_words(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li") for b in ("ne", "ro", "sal", "wick", "den", "por")]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = "idiot"
        rows.append((i, " ".join(w), "s"))
    plain = " ".join(rng.choice(words) for _ in range(40))
    rows += [(1000, plain + " 1d10t", "s"), (1001, plain + " i d i o t", "s"), (1002, plain + " idiiiot", "s"), (1003, plain, "s"), (1004, None, "s"), (1005, "", "s")]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int")
    logp = toxicity.character_model(docs)
    got = {r.doc_id: r.score for r in toxicity.score(docs, logp, toxicity.train(docs, labels, logp)).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(600))
    assert min(got[1000], got[1001], got[1002]) >= 0.5 > max(got[1003], got[1004], got[1005])
    none = toxicity.train(docs, labels.limit(0), logp)
    assert toxicity.score(docs.limit(1), logp, none).first().score < 0.5


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

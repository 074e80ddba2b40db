"""The corpus pipeline stage by stage against brute force, and learned operators on labels that they haven't seen."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodestrata.llm import decontamination, mixing, quality, toxicity
from lodestrata.llm.common import materialize, table
from test_corpus_operators import DOCS, brute_components, brute_hits

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline  # noqa: E402

SMALL = "/root/testdata/sf0.01"
with_tables = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(y)[order]
    below = np.searchsorted(s, s, side="left") + (np.searchsorted(s, s, side="right") - np.searchsorted(s, s, side="left") - 1) / 2
    k = y.sum()
    return (below[y == 1].sum() - k * (k - 1) / 2) / (k * (len(y) - k))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["river", "stone", "walks", "under", "slow", "light", "garden", "bridge", "early", "paper", "quiet", "north"]
    good = lambda n: " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(n)) + "."
    bad = lambda n: " ".join(rng.choice(["BUY", "NOW", "WIN"]) + "!!!" for _ in range(n))
    texts = [good(rng.randint(20, 90)) if i % 4 else bad(30) for i in range(240)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t)) for i, t in enumerate(texts)]
    passage = good(14)
    for k in range(20):  # copies, near copies, passages of the benchmark
        source = texts[4 * k + 1].split()
        source[3] = "other"
        rows.append((500 + k, texts[4 * k + 2] if k % 2 else " ".join(source), "en", "s0", 1))
        rows.append((600 + k, good(30) + " " + passage + " " + good(10) if k % 3 == 0 else good(25), "en", "s1", 1))
    rows += [(700, None, "en", "s0", 0), (701, "", "en", "s1", 0), (1, texts[5] + " more", "en", "s2", 1), (2, texts[2], "en", "s0", 1), (None, good(30), None, None, None)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, [passage]


def test_stages_against_brute_force(spark, folder):
    at, items = folder
    docs = table(spark, at, "documents")
    before = docs.collect()

    # Quality: features and fit in plain Python on the rows that aren't held out.
    train = sorted((r for r in before if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 3 != 1), key=lambda r: r.doc_id)
    x = np.array([quality.features((r.text or "").encode()) for r in train])
    model = quality.fit(x, np.array([int(r.doc_id % 4 > 0) for r in train]))
    want = Counter((r.doc_id, r.text) for r in before if model.score(np.array([quality.features((r.text or "").encode())]))[0] >= 0.5)
    docs = materialize(corpus_pipeline.quality_stage(spark, docs, at), "q")
    kept = docs.collect()
    assert Counter((r.doc_id, r.text) for r in kept) == want and docs.columns == table(spark, at, "documents").columns

    # Near duplicates: rows numbered in order of id, null first; the smallest of a component stays.
    distinct = sorted({(r.doc_id, r.text) for r in kept}, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    parts = brute_components([(i, t, "s") for i, (_, t) in enumerate(distinct)])
    smallest = {}
    for i, _, c in parts:
        smallest.setdefault(c, []).append(i)
    docs = materialize(corpus_pipeline.dedup_stage(spark, docs, at), "n")
    got = Counter((r.doc_id, r.text) for r in docs.collect())
    assert max(got.values()) == 1
    for members in smallest.values():
        ids = [distinct[i] for i in sorted(members)]
        left = [d for d in ids if d in got]
        assert len(left) == 1 and left[0][0] == ids[0][0]
    assert sum(got.values()) == len(smallest) < len(distinct)

    # Decontamination.
    want = {k for k in got if not brute_hits(k[1], [("1", items[0])])[1]}
    docs = materialize(corpus_pipeline.decontamination_stage(spark, docs, at), "d")
    assert {(r.doc_id, r.text) for r in docs.collect()} == want and len(want) < len(got)

    # Mixing: each row as often as its interval crosses integers, words near the targets.
    rows = docs.collect()
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(mixing.sized(docs.withColumn("__row", corpus_pipeline.row_digest("doc_id", "text")))).collect()}
    docs = materialize(corpus_pipeline.mixing_stage(spark, docs, at), "m")
    mixed = docs.collect()
    assert Counter((r.doc_id, r.source) for r in mixed) == +Counter(copies)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    for r in mixed:
        taken[r.source] += len((r.text or "").split())
    targets = {r.source: r.target for r in mixing.source_targets(mixing.sized(table(spark, at, "documents").limit(0).unionByName(spark.createDataFrame(rows, DOCS)))).collect()}
    assert all(abs(taken[s] - t) <= 100 for s, t in targets.items()) and set(targets) == set(sizes)

    # Sharding: no row is lost, slots are gapless, equal texts lie together.
    out = corpus_pipeline.sharding_stage(spark, docs, at).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in mixed)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())

    # All at once gives the same rows.
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, at).collect()) == Counter((r.doc_id, r.text) for r in out)


def test_stages_of_no_documents(spark, folder, tmp_path):
    docs = table(spark, folder[0], "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder[0]), "none")
        assert docs.count() == 0


def test_clashing_columns_change_nothing(spark, folder):
    docs = table(spark, folder[0], "documents").selectExpr("*", "1 AS rate", "'x' AS target", "2 AS n", "3 AS size", "4 AS score", "5 AS copies", "6 AS key", "7 AS rep")
    model = quality.train(docs, table(spark, folder[0], "labels"), "quality", held_out=1, modulus=3)
    assert quality.score(docs, model).filter("rate = 1 and target = 'x' and score between 0 and 1").count() == docs.count()
    assert decontamination.decontaminate(docs, table(spark, folder[0], "benchmark")).count() == docs.count()
    kept = corpus_pipeline.dedup_stage(spark, docs, folder[0])
    assert kept.columns == docs.columns and corpus_pipeline.mixing_stage(spark, kept, folder[0]).columns == docs.columns


@with_tables
@pytest.mark.parametrize("query,label,floor", [(quality.op9_quality, "quality", 0.97), (toxicity.op7_toxicity, "toxic", 0.85)])
def test_held_out_labels(spark, query, label, floor):
    got = query(spark, SMALL).filter("held_out").join(table(spark, SMALL, "labels"), "doc_id").select("score", label).filter(f"{label} is not null").toPandas()
    value = auc(got.score.to_numpy(), got[label].to_numpy())
    print(label, len(got), value)
    assert value >= floor

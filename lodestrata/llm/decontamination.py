"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document.  A shard is one row: the documents of a slice
of the input, and for each term its positions as offsets from one another on a
line on which the shard's documents lie one after the other, with gaps.  It
is built in one pass without a shuffle and written to the shared folder.

A query reads the shards.  Terms' counts over all shards say which terms of a
phrase are rarest; in each shard the lists of the phrase's terms, each shifted by
the term's offset in the phrase, are intersected from the rarest on.  What is
left is the phrase's exact occurrences.  Proximity search takes the rarest
term's places and keeps spans in which all terms occur.

The test set comes in blocks of bounded size, each broadcast by itself, so it
may have any size.  If its vocabulary is within ``MAX_VOCABULARY`` the
index holds those terms only, and else all terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

WINDOW = 10
SHARD_ROWS = 2000
MAX_VOCABULARY = 1_000_000
BLOCK_WORDS = 1_000_000
#: A word is a run of digits, letters a-z and characters beyond ASCII.
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text; ``bytes.lower`` changes A-Z alone."""
    return WORD_BYTES.findall(data.lower()) if data else []


def _packed(positions: np.ndarray) -> bytes:
    """Differences, in as few bytes each as the largest needs."""
    steps = np.diff(positions, prepend=0)
    top = int(steps.max())
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return steps.astype(kind).tobytes() + bytes([np.dtype(kind).itemsize])


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob[:-1], f"<u{blob[-1]}").astype(np.int64))


def build_index(docs: DataFrame, key: str, text: str, vocabulary: set[bytes] | None = None, gap: int = WINDOW) -> DataFrame:
    """The positional index of whole texts; ``key``, of any type, names rows and comes back in ``rows``.

    Null and empty texts are documents without words.  Keys may repeat or be null.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({w: i for i, w in enumerate(sorted(vocabulary))} if vocabulary is not None else None)

    def index(t: pa.Table) -> pa.Table:
        import uuid

        ids = known.value
        names = list(ids) if ids is not None else []
        own: dict[bytes, int] = {}
        lengths, found, start = [], [], 0
        for data in t.column("__bytes").to_pylist():
            ws = words(data)
            if ids is not None:
                here = np.array([ids.get(w, -1) for w in ws], dtype=np.int64)
            else:
                here = np.array([own.setdefault(w, len(own)) for w in ws], dtype=np.int64)
            at = np.flatnonzero(here >= 0)
            if len(at):
                found.append((here[at], at + start))
            lengths.append(len(ws))
            start += len(ws) + gap
        if ids is None:
            names = list(own)
        terms, counts, lists = [], [], []
        if found:
            term, place = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            cuts = np.flatnonzero(np.diff(term)) + 1
            lists = [_packed(x) for x in np.split(place, cuts)]
            heads = term[np.concatenate([[0], cuts])]
            terms, counts = [names[i] for i in heads], np.diff(np.concatenate([[0], cuts, [len(term)]])).tolist()
        kinds = (pa.string(), pa.list_(t.schema.field("__key").type), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        row = (uuid.uuid4().hex, t.column("__key").to_pylist(), lengths, terms, counts, lists)
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "rows", "lengths", "terms", "counts", "postings"])

    narrow = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__bytes"))
    kind = narrow.schema["__key"].dataType.simpleString()
    schema = f"shard string, rows array<{kind}>, lengths array<int>, terms array<binary>, counts array<int>, postings array<binary>"
    return materialize(map_arrow(narrow, index, schema, SHARD_ROWS), "index")


def term_counts(index: DataFrame, terms: Iterable[bytes]) -> dict[bytes, int]:
    """Collection frequency of the given terms (a bounded list: those of one block)."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("n"))
    got = pairs.groupBy("term").agg(F.sum("n").alias("n")).join(wanted, "term", "left_semi").toArrow()
    return dict(zip(got.column("term").to_pylist(), got.column("n").to_pylist(), strict=True))


class _Shard:
    """One row of the index, with lists unpacked when asked for."""

    def __init__(self, lengths: list[int], terms: list[bytes], postings: list[bytes], gap: int):
        self.at, self.postings, self.open = {t: i for i, t in enumerate(terms)}, postings, {}
        self.lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + gap)[:-1]]).astype(np.int64)

    def places(self, term: bytes) -> np.ndarray:
        if term not in self.open:
            i = self.at.get(term)
            self.open[term] = _unpacked(self.postings[i]) if i is not None else np.empty(0, np.int64)
        return self.open[term]

    def phrase(self, phrase: list[bytes], order: list[int]) -> np.ndarray:
        """Starts of the phrase: lists shifted by their offsets, intersected in ``order``."""
        starts = None
        for k in order:
            shifted = self.places(phrase[k]) - k
            if starts is None:
                starts = shifted[shifted >= 0]
            elif len(shifted):
                i = np.minimum(np.searchsorted(shifted, starts), len(shifted) - 1)
                starts = starts[shifted[i] == starts]
            else:
                starts = shifted
            if not len(starts):
                break
        return starts

    def near(self, terms: list[bytes], width: int) -> np.ndarray:
        """Spans [start, end) of at most ``width`` words with all terms, one from each place where the rarest begins or ends it or lies in it."""
        lists = sorted((self.places(t) for t in set(terms)), key=len)
        if not lists or not len(lists[0]):
            return np.empty((0, 2), np.int64)
        merged = np.concatenate(lists)
        kind = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(merged, kind="stable")
        merged, kind = merged[order], kind[order]
        # For each place as the end of a span: the latest place of every term up to it.
        low = np.full(len(merged), np.iinfo(np.int64).max)
        for k in range(len(lists)):
            last = np.maximum.accumulate(np.where(kind == k, merged, -(1 << 40)))
            low = np.minimum(low, last)
        ok = (merged - low < width) & (np.searchsorted(self.starts, low, side="right") == np.searchsorted(self.starts, merged, side="right"))
        spans = np.stack([low[ok], merged[ok] + 1], axis=1)
        # Of spans with the same start the shortest.
        return spans[np.concatenate([[True], spans[1:, 0] != spans[:-1, 0]])] if len(spans) else spans

    def local(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.starts, places, side="right") - 1
        return row, places - self.starts[row]


def windows(item: list[bytes], width: int = WINDOW) -> list[list[bytes]]:
    """All runs of ``width`` words; a shorter item, if not empty, is one."""
    return [item[i : i + width] for i in range(max(1, len(item) - width + 1))] if item else []


def blocks(items: Iterable[tuple[str, list[bytes]]], size: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, held = [], 0
    for name, ws in items:
        if block and held + len(ws) > size:
            yield block
            block, held = [], 0
        block.append((name, ws))
        held += len(ws)
    if block:
        yield block


def benchmark_items(benchmark: DataFrame) -> Iterator[tuple[str, list[bytes]]]:
    """Items one after the other, without holding them all; a null id is the empty string."""
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text")).toLocalIterator():
        if r[1] and (ws := words(r[1].encode())):
            yield r[0], ws


def phrase_matches(index: DataFrame, items: list[tuple[str, list[bytes]]], width: int = WINDOW, gap: int = WINDOW) -> DataFrame:
    """For a block of items: one row for each indexed document, with ``items`` and intervals of words that are hit.

    Columns ``shard, row`` (the document's number in the shard), ``key, n_words,
    items, starts, ends``; the intervals of one item are merged, those of
    different items stay apart.
    """
    spark = index.sparkSession
    counts = term_counts(index, {w for _, ws in items for w in ws})
    plans: dict[tuple[bytes, ...], tuple[list[int], list[int]]] = {}
    for i, (_, ws) in enumerate(items):
        for win in windows(ws, width):
            order = sorted(range(len(win)), key=lambda k: (counts.get(win[k], 0), k))
            if counts.get(win[order[0]], 0):
                plans.setdefault(tuple(win), (order, []))[1].append(i)
    # By the rarest term, so that a shard's work follows the terms that it shares with the block.
    by_rarest: dict[bytes, list[tuple[list[bytes], list[int], list[int]]]] = {}
    for w, (order, own) in plans.items():
        by_rarest.setdefault(w[order[0]], []).append((list(w), order, sorted(set(own))))
    sent = spark.sparkContext.broadcast(([n for n, _ in items], by_rarest))

    def match(t: pa.Table) -> pa.Table:
        names, wanted = sent.value
        key_kind = t.schema.field("rows").type.value_type
        out: dict[str, list] = {k: [] for k in ("shard", "row", "key", "n_words", "items", "starts", "ends")}
        for r in t.to_pylist():
            shard = _Shard(r["lengths"], r["terms"], r["postings"], gap)
            hits: dict[int, list[tuple[int, int, int]]] = {}
            for win, order, own in (x for term in shard.at if term in wanted for x in wanted[term]):
                if any(win[k] not in shard.at for k in order):
                    continue
                starts = shard.phrase(win, order)
                if len(starts):
                    for row, place in zip(*(x.tolist() for x in shard.local(starts)), strict=True):
                        for i in own:
                            hits.setdefault(row, []).append((i, place, place + len(win)))
            for row, (key, n) in enumerate(zip(r["rows"], r["lengths"], strict=True)):
                merged: list[list[int]] = []
                for i, a, b in sorted(hits.get(row, ())):
                    if merged and merged[-1][0] == i and a <= merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], b)
                    else:
                        merged.append([i, a, b])
                for k, v in zip(out, (r["shard"], row, key, n, sorted({names[m[0]] for m in merged}), [m[1] for m in merged], [m[2] for m in merged]), strict=True):
                    out[k].append(v)
        kinds = (pa.string(), pa.int32(), key_kind, pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    kind = index.schema["rows"].dataType.elementType.simpleString()
    schema = f"shard string, row int, key {kind}, n_words bigint, items array<string>, starts array<int>, ends array<int>"
    return map_arrow(index.select("shard", "rows", "lengths", "terms", "postings"), match, schema, 4)


def proximity_matches(index: DataFrame, queries: list[tuple[str, list[bytes]]], width: int, gap: int = WINDOW) -> DataFrame:
    """``key, query, start, end``: spans of at most ``width`` words that hold all the query's terms."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def match(t: pa.Table) -> pa.Table:
        rows = []
        for r in t.to_pylist():
            shard = _Shard(r["lengths"], r["terms"], r["postings"], gap)
            for name, terms in sent.value:
                if all(x in shard.at for x in terms):
                    for a, b in shard.near(terms, width).tolist():
                        row, place = shard.local(np.array([a]))
                        rows.append((r["rows"][row[0]], name, int(place[0]), int(place[0]) + b - a))
        kinds = (t.schema.field("rows").type.value_type, pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["key", "query", "start", "end"])

    kind = index.schema["rows"].dataType.elementType.simpleString()
    return map_arrow(index.select("rows", "lengths", "terms", "postings"), match, f"key {kind}, query string, start bigint, end bigint", 4)


def _union_length(starts: str, ends: str):
    """Words covered by the intervals, each word once."""
    pairs = F.array_sort(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(
        pairs,
        zero,
        lambda acc, p: F.struct(
            (acc["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], acc["end"]))).cast("bigint").alias("n"),
            F.greatest(acc["end"], p["b"]).cast("bigint").alias("end"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """``key, n_words, n_hit, items`` for each row of ``docs``.

    A word is hit if an occurrence of a window of a benchmark item covers it.
    Null and empty texts have no words; an empty benchmark hits nothing; equal
    rows give equal rows.
    """
    seen: set[bytes] = set()
    for _, ws in benchmark_items(benchmark):
        seen.update(ws)
        if len(seen) > MAX_VOCABULARY:
            break
    index = build_index(docs, key, text, seen if len(seen) <= MAX_VOCABULARY else None, width)
    found = [phrase_matches(index, block, width, width) for block in blocks(benchmark_items(benchmark))] or [phrase_matches(index, [], width, width)]
    if len(found) == 1:
        merged = found[0]
    else:
        merged = found[0]
        for f in found[1:]:
            merged = merged.unionByName(f)
        merged = merged.groupBy("shard", "row").agg(
            F.first("key").alias("key"), F.min("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "starts", "ends")],
        )
    return merged.select(
        F.col("key").alias(key), "n_words", _union_length("starts", "ends").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items")
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []::VARCHAR[]) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) AS g
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS l FROM win),
grams AS (SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS g
          FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
m AS (SELECT doc_id, i, l, item FROM grams JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""
}

QUERIES = {"op1_decontaminate": op1_decontaminate}

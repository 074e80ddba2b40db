"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

All n-grams have one global order: those that are rare in the corpus first (in the
order of their 64-bit hashes), those found in several documents last.  Documents
with equal sets form a class, and classes are joined.

Candidates share an n-gram among the first ``|S| - ceil(0.8 |S|) + 1`` of each.
The order is cut into ``FRAGMENTS`` fragments: each candidate's set is stored as
one segment a fragment, the overlap of a pair is counted in each fragment by
itself, and the partial counts are summed for each pair.

What is asked for are links up to connection, so a bucket of m classes isn't
expanded into its pairs: its classes are first compared with two leaders of the
bucket.  Then only pairs of a bucket whose classes are still in different
components are listed, where sizes, places in the order and the sets' sizes in
ranges of hashes allow the overlap, and where no n-gram just before the bucket's
is shared too, for then an earlier bucket lists the pair.  All of these are
verified.  No bucket is cut off; a large one is dealt out in blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, release, table
from .components import connected_components

N = 5
PERCENT = 80
FRAGMENTS = 4
#: Ranges of hashes for which a set's sizes are kept: the sum of the lesser sizes bounds an overlap.
PARTS = 128
#: Bits of a table of hashes; its size doesn't depend on the input's.  They mark
#: frequent n-grams, keys of several rows, buckets, and texts that are to be cut; all that matters is checked exactly.
FILTER_BITS = 1 << 27
#: About so many n-grams are marked as frequent; which ones depends on their counts.
MARKED = FILTER_BITS // 8
#: Shared n-grams before a bucket's own that each of its rows carries.
EARLIER = 4
#: Rows of a bucket above which it is dealt out in blocks, each met with each other in a task of its own.
BLOCK_ROWS = 4096


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_hashes(data: bytes | None, cache: dict, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of one whole text (A-Z lower-cased)."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    last = len(words) - n + 1
    h = ids[:last].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[k : last + k]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _bytes_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``rid`` names a row by its key and text, so that texts under one key stay apart; equal rows share it."""
    data = F.col(text).cast("binary")
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), data).alias("rid"), data.alias("__bytes"))


def bit_table(ids: DataFrame, column: str) -> np.ndarray:
    """``FILTER_BITS`` bits, set at the places of a column's values modulo that many."""
    place = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    rows = (
        ids.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )
    got = rows.toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, bits in zip(got.column("k").to_pylist(), got.column("bits"), strict=True):
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def is_set(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = (values & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return ((table[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def marked(sent: Broadcast, column: Column) -> Column:
    """Whether a sent table of bits has that of the column's 64-bit value, by chance too; other columns don't go to Python."""

    @F.arrow_udf("boolean")
    def found(values: pa.Array) -> pa.Array:
        return pa.array(is_set(sent.value, values.to_numpy(zero_copy_only=False).view(np.uint64)))

    return found(column)


def frequent_ngrams(docs: DataFrame, n: int, percent: int) -> np.ndarray:
    """Bit table of n-grams that several documents have near the start of the order of hashes.

    Counts are over all documents.  The least count that marks an n-gram is the
    smallest power of two with at most ``MARKED`` n-grams.  The table only
    orders n-grams: what shares a bit by chance, or is missed, costs time and no links.
    """

    def early(t: pa.Table) -> pa.Table:
        cache = _WordHashes()
        sets = [ngram_hashes(b, cache, n) for b in t.column("__bytes").to_pylist()]
        return pa.table({"h": _lists([s[: prefix_length(len(s), percent) * 5 // 4] for s in sets])})

    hashes = map_arrow(docs.select("__bytes"), early, "h array<bigint>").select(F.explode("h").alias("h"))
    counts = materialize(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "counts")
    levels = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("l")).count().collect()}
    least = max(levels, default=1)
    while least > 1 and sum(v for k, v in levels.items() if k >= least - 1) <= MARKED:
        least -= 1
    frequent = bit_table(counts.filter(F.col("c") >= (1 << least)), "h")
    discard(counts)
    return frequent


def ordered(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    last = is_set(frequent, h)
    return np.concatenate([h[~last], h[last]])


def _sizes(h: np.ndarray) -> bytes | None:
    """Members of a set in each of ``PARTS`` ranges of hashes, a byte each; None if one has over 255."""
    counts = np.bincount((h >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def n_gram_sets(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """``doc_id, rid, n, key`` (128-bit hash of the set; null if empty), ``prefix`` and ``sizes``, written."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def sets(t: pa.Table) -> pa.Table:
        cache = _WordHashes()
        found = [ngram_hashes(b, cache, n) for b in t.column("__bytes").to_pylist()]
        return pa.table({
            "doc_id": t.column("doc_id"),
            "rid": t.column("rid"),
            "n": pa.array([len(s) for s in found], pa.int64()),
            "key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
            "prefix": _lists([ordered(s, sent.value)[: prefix_length(len(s), percent)] for s in found]),
            "sizes": pa.array([_sizes(s) for s in found], pa.binary()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = materialize(map_arrow(docs, sets, f"doc_id {kind}, rid bigint, n bigint, key binary, prefix array<bigint>, sizes binary"), "sets")
    sent.destroy()
    return out


def copied_classes(wide: DataFrame, sent: Broadcast) -> DataFrame:
    """Classes ``key, rep, least, n, prefix, sizes`` of the rows of written sets whose keys are marked in ``sent``, written."""
    return materialize(
        wide.filter(F.col("key").isNotNull()).filter(marked(sent, F.xxhash64("key"))).groupBy("key")
        .agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", "sizes")]),
        "classes",
    )


def lone_classes(wide: DataFrame, sent: Broadcast) -> DataFrame:
    """The other rows, each a class of its own: their prefixes are neither shuffled nor written again."""
    lone = wide.filter(F.col("key").isNotNull()).filter(~marked(sent, F.xxhash64("key")))
    return lone.select("key", F.col("rid").alias("rep"), F.col("doc_id").alias("least"), "n", "prefix", "sizes")


def buckets(classes: DataFrame) -> DataFrame:
    """``h, rep, n, pos`` of n-grams that two or more classes have in their prefixes, ``rare``, and ``e1`` to ``e4``, written.

    ``rare`` counts the class's n-grams in the prefix that no other has there.  The last are the n-grams before ``h`` in the class's prefix that may be shared
    (0: none).  A table of bits skips most rows that the join would drop.
    """
    several = materialize(
        classes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "several"
    )
    release(classes.sparkSession)
    sent = classes.sparkSession.sparkContext.broadcast(bit_table(several, "h"))

    def rows(t: pa.Table) -> pa.Table | None:
        lists = t.column("prefix").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(lengths)), lengths)
        h = lists.flatten().to_numpy(zero_copy_only=False)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = is_set(sent.value, h.view(np.uint64))
        h, own, pos = h[keep], own[keep], pos[keep]
        out = {"h": h, "rep": t.column("rep").to_numpy()[own], "n": t.column("n").to_numpy()[own], "pos": pos.astype(np.int64)}
        out["rare"] = (lengths - np.bincount(own, minlength=len(lengths)))[own].astype(np.int64)
        for k in range(1, EARLIER + 1):
            before = np.zeros(len(h), np.int64)
            before[k:] = np.where(own[k:] == own[:-k], h[:-k], 0)
            out[f"e{k}"] = before
        return pa.table(out)

    schema = "h bigint, rep bigint, n bigint, pos bigint, rare bigint" + "".join(f", e{k} bigint" for k in range(1, EARLIER + 1))
    out = materialize(map_arrow(classes.select("rep", "n", "prefix"), rows, schema).join(several, "h", "left_semi"), "members")
    sent.destroy()
    discard(several)
    return out


def leader_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, na, b, nb`` of each class with two leaders of its bucket, where bounds allow a link.

    The leaders are the class with the fewest n-grams of its own, for edits of a text
    make such, and that with the fewest before the bucket's; buckets of like classes
    mostly have the same leaders.
    """
    own = ("rep", "n", "pos")
    leaders = members.groupBy("h").agg(F.min(F.struct("rare", *own)).alias("__l0"), F.min(F.struct("pos", "rep", "n")).alias("__l1"))
    both = F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in own]) for x in ("__l0", "__l1")])

    def allowed(x: Column) -> Column:
        """Whether the sizes, and the places of the first shared n-gram, allow the similarity."""
        most = F.least(F.col("n") - F.col("pos"), x["n"] - x["pos"])
        sizes = F.least("n", x["n"]) * 100 >= F.greatest("n", x["n"]) * percent
        return (x["rep"] != F.col("rep")) & sizes & (most * 100 >= (F.col("n") + x["n"] - most) * percent)

    met = members.select("h", *own).join(leaders, "h").select(*own, F.explode(F.filter(both, allowed)).alias("x"))
    low = F.col("rep") < F.col("x.rep")
    pick = lambda c, first: F.when(low if first else ~low, F.col(c)).otherwise(F.col(f"x.{c}"))
    return met.select(pick("rep", True).alias("a"), pick("n", True).alias("na"), pick("rep", False).alias("b"), pick("n", False).alias("nb")).distinct()


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[dict[str, np.ndarray]]:
    """Whole runs of equal values in the column ``by`` from batches that are sorted by it."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        cut = int(np.searchsorted(now[by], now[by][-1], side="left")) if len(now[by]) else 0
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
        held = {c: v[cut:] for c, v in now.items()}
    if held is not None and len(held[by]):
        yield held


def _dealt(members: DataFrame) -> DataFrame:
    """Adds ``g``, the task's group, ``block`` and ``cross``: whether only rows of different blocks meet in it.

    A bucket of ``m`` rows makes ``m / BLOCK_ROWS`` blocks, rounded up, and each two blocks a group.
    """
    blocks = F.ceil(F.col("m") / BLOCK_ROWS)
    own = F.pmod(F.xxhash64("rep", F.lit(11)), blocks)
    return (
        members.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .withColumn("g", F.xxhash64("h", F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("cross", F.col("block") != F.col("other"))
    )


def _states(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``h, m, mixed``, written: a bucket's rows, and whether they are of several components.  Small buckets of one component are left out."""
    of = members.select("h", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("h", F.coalesce("component", "rep").alias("comp"))
    found = of.groupBy("h").agg(F.count(F.lit(1)).alias("m"), (F.min("comp") != F.max("comp")).alias("mixed"))
    return materialize(found.filter(F.col("mixed") | (F.col("m") > BLOCK_ROWS)), "states")


def _still_open(members: DataFrame, comps: DataFrame, sizes: DataFrame, states: DataFrame, sent: Broadcast) -> DataFrame:
    """Members with their components and sizes, of the buckets that still have more than one; ``m`` is the bucket's rows, or 1 if it is small.

    A table of bits finds the buckets, so only rows that are asked for are shuffled; a small bucket may
    come by chance.  Those with over ``BLOCK_ROWS`` rows, so at most one for as many rows, are broadcast.
    """
    large = states.filter(F.col("m") > BLOCK_ROWS)
    rows = members.filter(marked(sent, F.col("h"))).join(F.broadcast(large), "h", "left").filter(F.coalesce("mixed", F.lit(True))).withColumn("m", F.coalesce("m", F.lit(1).cast("bigint")))
    where = sizes.join(comps, F.col("rep") == F.col("node"), "left").select("rep", "sizes", F.coalesce("component", "rep").alias("comp"))
    return rows.join(where, "rep")


def open_pairs(members: DataFrame, comps: DataFrame, sizes: DataFrame, percent: int, chunk: int = 1 << 20) -> DataFrame:
    """Pairs ``a, na, b, nb`` of a bucket in different components whose bounds allow a link, written.

    Of the pair's buckets only those list it in whose rows no earlier n-gram is
    the same, among them that of its first shared n-gram.  The overlap is at most
    the sum, over ranges of hashes, of the lesser of both sizes.
    """
    earlier = [f"e{k}" for k in range(1, EARLIER + 1)]
    narrow = ["g", "rep", "n", "pos", "comp", "sizes", "block", "cross", *earlier]

    def listed(r: dict[str, np.ndarray], part: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, n, pos, comp, rep = (r[c][part] for c in ("g", "n", "pos", "comp", "rep"))
        block, cross = r["block"][part], r["cross"][part]
        before = np.stack([r[c][part] for c in earlier], axis=1)
        blobs = r["sizes"][part]
        known = np.array([x is not None for x in blobs])
        sizes = np.frombuffer(b"".join(x or bytes(PARTS) for x in blobs), np.uint8).reshape(-1, PARTS)
        # In order of group and size: partners of i are those after it, up to the size that its own size and place allow.
        group = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]).astype(np.int64)]))
        limit = np.minimum(n * 100 // percent, (n - pos) * (100 + percent) // percent - n)
        upto = np.searchsorted((group << 32) + n, (group << 32) + np.maximum(limit, 0), side="right")
        width = np.maximum(upto - np.arange(len(n)) - 1, 0)
        ends = np.cumsum(width)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
            w = width[at:to]
            i = np.repeat(np.arange(at, at + len(w)), w)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            at = to
            ok = (comp[i] != comp[j]) & ((block[i] != block[j]) | ~cross[i])
            i, j = i[ok], j[ok]
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])
            ok = 100 * most >= percent * (n[i] + n[j] - most)
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 65536):
                x, y = i[k : k + 65536], j[k : k + 65536]
                seen = np.zeros(len(x), bool)
                for c in range(EARLIER):
                    mine = before[x, c]
                    seen |= (mine != 0) & (before[y] == mine[:, None]).any(axis=1)
                x, y = x[~seen], y[~seen]
                most = np.minimum(sizes[x], sizes[y]).sum(axis=1, dtype=np.int64)
                ok = (100 * most >= percent * (n[x] + n[y] - most)) | ~(known[x] & known[y])
                x, y = x[ok], y[ok]
                if len(x):
                    swap = rep[x] > rep[y]
                    a, b = np.where(swap, y, x), np.where(swap, x, y)
                    yield pa.RecordBatch.from_pydict({"a": rep[a], "na": n[a], "b": rep[b], "nb": n[b]})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, "g"):
            first = np.flatnonzero(np.concatenate([[True], r["g"][1:] != r["g"][:-1]]))
            mixed = np.minimum.reduceat(r["comp"], first) != np.maximum.reduceat(r["comp"], first)
            part = np.flatnonzero(np.repeat(mixed, np.diff(np.append(first, len(r["g"])))))
            if len(part):
                yield from listed(r, part[np.lexsort((r["rep"][part], r["n"][part], r["g"][part]))])

    states = _states(members, comps)
    release(members.sparkSession)
    sent = members.sparkSession.sparkContext.broadcast(bit_table(states.filter("mixed"), "h"))
    dealt = _dealt(_still_open(members, comps, sizes, states, sent)).select(*narrow).repartition("g").sortWithinPartitions("g")
    out = materialize(dealt.mapInArrow(scan, "a bigint, na bigint, b bigint, nb bigint").distinct(), "open")
    sent.destroy()
    discard(states)
    return out


def segments(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``rep, fragment, segment`` of each class of ``members`` (a row for each ``rep``) and its other columns, written.

    Texts are read again; a filter of bounded size skips most that aren't
    asked for, and the join drops what the filter lets through by chance.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(members, "rep"))
    bits = FRAGMENTS.bit_length() - 1

    def cut(t: pa.Table) -> pa.Table | None:
        t = t.filter(pa.array(is_set(sent.value, t.column("rid").to_numpy().view(np.uint64))))
        if not t.num_rows:
            return None
        cache, ids, parts = _WordHashes(), [], []
        for row, b in zip(t.column("rid").to_pylist(), t.column("__bytes").to_pylist(), strict=True):
            h = ngram_hashes(b, cache, n)
            ids.append(row)
            parts += np.split(h, np.searchsorted(h, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(64 - bits)))
        return pa.table({"rep": np.repeat(np.array(ids, np.int64), FRAGMENTS), "fragment": np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(ids)), "segment": _lists(parts)})

    found = map_arrow(docs.select("rid", "__bytes"), cut, "rep bigint, fragment int, segment array<bigint>")
    out = materialize(found.join(members, "rep").dropDuplicates(["rep", "fragment"]), "segments")
    sent.destroy()
    return out


def verified(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of those pairs ``a, na, b, nb`` that link: partial overlaps by fragment, summed for each pair.

    Segments have ``as_a`` and ``as_b``, whether a pair has their class there.
    """
    left = segs.filter("as_b").select(F.col("rep").alias("b"), "fragment", F.col("segment").alias("__sb"))
    right = segs.filter("as_a").select(F.col("rep").alias("a"), "fragment", F.col("segment").alias("__sa"))
    partial = (
        pairs.join(left, "b").join(right, ["a", "fragment"])
        .select("a", "na", "b", "nb", F.size(F.array_intersect("__sa", "__sb")).alias("o"))
    )
    both = partial.groupBy("a", "na", "b", "nb").agg(F.sum("o").alias("o"))
    return both.filter(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def linked(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` that link, written."""
    release(docs.sparkSession)
    sides = F.array(*[F.struct(F.col(c).alias("rep"), F.lit(c == "a").alias("as_a"), F.lit(c == "b").alias("as_b")) for c in ("a", "b")])
    asked = pairs.select(F.inline(sides)).groupBy("rep").agg(F.bool_or("as_a").alias("as_a"), F.bool_or("as_b").alias("as_b"))
    segs = segments(docs, asked, n)
    release(docs.sparkSession)
    out = materialize(verified(pairs, segs, percent), "links")
    discard(segs, pairs)
    release(docs.sparkSession)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id`` for each row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their sets
    of word n-grams; ``component_id`` is the smallest key that links reach.
    With fewer words than ``n`` the whole sequence is the set's one member.
    Null, empty and blank texts have empty sets and stand alone.  Equal rows
    give equal rows; several texts under one key are documents of their own.
    A row with a null key links as others do, and its null counts as no
    component's smallest key.  Sets are compared by 64-bit hashes of n-grams,
    and rows named by 64-bit hashes.
    """
    spark = docs.sparkSession
    source = _bytes_of(docs, key, text)
    frequent = frequent_ngrams(source, n, percent)
    release(spark)
    # Prefixes are the most of these tables: only those of keys with several rows are shuffled and written again.
    wide = n_gram_sets(source, frequent, n, percent)
    del frequent  # the driver holds a table of bits only until it is read
    several = wide.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    sent = spark.sparkContext.broadcast(bit_table(several.select(F.xxhash64("key").alias("k")), "k"))
    copied = copied_classes(wide, sent)
    release(spark)
    whole = lone_classes(wide, sent).unionByName(copied)
    members = buckets(whole)
    classes = materialize(whole.select("key", "rep", "least", "sizes"), "named")
    sets = materialize(wide.select("doc_id", "n", "key"), "rows")
    discard(wide, copied)
    sent.destroy()
    del sent
    release(spark)
    links = linked(source, materialize(leader_pairs(members, percent), "pairs"), n, percent)
    comps = connected_components(links)
    release(spark)
    more = open_pairs(members, comps, classes.select("rep", "sizes"), percent)
    discard(members)
    release(spark)
    if not more.isEmpty():
        comps = connected_components(links.unionByName(linked(source, more, n, percent)))
    named = classes.select("key", "rep", "least").join(comps, F.col("rep") == F.col("node"), "left").select("key", "least", "component")
    smallest = named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("__c"))
    by_key = named.join(smallest, "component", "left").select("key", F.coalesce("__c", "least").alias("__c"))
    return (
        sets.select("doc_id", "n", "key").join(by_key, "key", "left")
        .select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("__c", "doc_id").alias("component_id"))
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = {
    "op10_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + {N - 1})) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {N - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * o >= {PERCENT} * (ca.n + cb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, k.m AS component_id
FROM w LEFT JOIN c USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) k ON k.a = w.doc_id"""
}

QUERIES = {"op10_ngram_join": op10_ngram_join}

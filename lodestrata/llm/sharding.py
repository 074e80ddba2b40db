"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group.  Groups are put into bundles by hash,
a number that depends on the number of shards alone, and the bundles' vectors
(bytes, tokens, rows) are packed on the driver: the largest first, each into
the shard where the weighted dot product of its vector with the residual capacity is
highest, over all shards.  A group that outweighs a bundle is a unit of its own,
dealt over several tasks by the hash of ``doc_id``.  A group that outweighs a
whole shard, in bytes, tokens or rows, can't stay in one: it is placed in
lots of a quarter of a shard.  At most ``3 * shards * BUNDLES_PER_SHARD`` groups
outweigh a bundle, so what reaches the driver is bounded by the number of shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, word_count

SHARDS = 40
BUNDLES_PER_SHARD = 256
OVERHEAD = 16
#: How much bytes, tokens and rows count in the dot product; bytes most, as tasks are as long as their bytes.
WEIGHTS = (20.0, 5.0, 1.0)
#: The share of a shard that a lot has of a group that outweighs one.
LOT = 1 / 4
#: Numbers of bundles of heavy groups: the group's number times this, and the piece.
PIECES = 1 << 32


def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of each row of ``vectors``; deterministic, ties to the lower shard."""
    total = vectors.sum(axis=0).astype(float)
    unit = np.divide(vectors * shards, total, out=np.zeros(vectors.shape), where=total > 0)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    weighted = unit * np.array(weights)
    for i in np.lexsort((np.arange(len(unit)), -unit.max(axis=1))) if len(unit) else []:
        out[i] = int(np.argmax(residual @ weighted[i]))
        residual[out[i]] -= unit[i]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, tokens`` and the md5 of the text (null: that of no group's text)."""
    text = F.col("text")
    return docs.select(
        "*",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        word_count(text).alias("tokens"),
        F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("__text_key"),
    )


def assign(docs: DataFrame, shards: int = SHARDS, narrow: DataFrame | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that have ``fingerprints``' columns; others stay.

    ``narrow``: a written table of those columns without others, if there is
    one.  Shards are filled to near equal bytes, tokens and rows.  Slots run
    gapless from 0 within a shard: a bundle's offset is known from the bundles'
    counts, and the place within it comes from a window over the bundle alone.
    Null text counts as empty.  Equal rows keep rows of their own; their order
    falls to ``doc_id``.  No rows: none out.
    """
    spark = docs.sparkSession
    bundles = shards * BUNDLES_PER_SHARD
    if narrow is None:
        narrow = materialize(docs.select("doc_id", "size", "tokens", "__text_key"), "fingerprints")
    totals = [float(x or 0) for x in narrow.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()]
    #: The largest of a group's shares of all bytes, tokens and rows.
    share = F.greatest(*[F.col(f"__{c}") / F.lit(max(1.0, t)) for c, t in zip(("bytes", "tokens", "n"), totals, strict=True)])
    groups = narrow.groupBy("__text_key").agg(F.sum("size").alias("__bytes"), F.sum("tokens").alias("__tokens"), F.count(F.lit(1)).alias("__n"))
    heavy = groups.select("__text_key", "__n", share.alias("share")).filter(F.col("share") > 1 / bundles).orderBy("__text_key").collect()
    # Pieces weigh about half a bundle, if their rows weigh no more.
    pieces = [(bytes(r[0]), k, int(min(-(-2 * r[2] * bundles // 1), r[1]))) for k, r in enumerate(heavy, 1)]
    lots = {k: max(1, n if r[2] * shards <= 1 else int(n * LOT / (r[2] * shards))) for (_, k, n), r in zip(pieces, heavy, strict=True)}
    known = spark.createDataFrame(pieces, "__heavy_key binary, __group bigint, __pieces bigint")

    def keyed(df: DataFrame) -> DataFrame:
        piece = F.pmod(F.xxhash64("doc_id"), F.col("__pieces"))
        light = F.pmod(F.xxhash64("__text_key"), F.lit(bundles))
        return (
            df.join(F.broadcast(known), F.col("__text_key") == F.col("__heavy_key"), "left")
            .withColumn("__bundle", F.when(F.col("__pieces").isNull(), light).otherwise(F.col("__group") * PIECES + piece))
            .drop("__heavy_key", "__pieces", "__group")
        )

    sums = keyed(narrow).groupBy("__bundle").agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).orderBy("__bundle").collect()
    units = [r[0] if r[0] < PIECES else (r[0] // PIECES, r[0] % PIECES // lots[r[0] // PIECES]) for r in sums]
    number = {u: i for i, u in enumerate(dict.fromkeys(units))}
    vectors = np.zeros((len(number), 3))
    for u, r in zip(units, sums, strict=True):
        vectors[number[u]] += r[1:4]
    placed = pack(vectors, shards)
    chosen = [placed[number[u]] for u in units]
    start, filled = [], [0] * shards
    for r, s in zip(sums, chosen, strict=True):
        start.append(filled[s])
        filled[s] += r[3]
    plan = spark.createDataFrame(
        [(r[0], int(s), o) for r, s, o in zip(sums, chosen, start, strict=True)], "__b bigint, shard int, __start bigint"
    )
    within = Window.partitionBy("__bundle").orderBy("__text_key", "doc_id")
    return (
        keyed(docs)
        .withColumn("__place", F.row_number().over(within) - 1)
        .join(F.broadcast(plan), F.col("__bundle") == F.col("__b"))
        .withColumn("slot", F.col("__start") + F.col("__place"))
        .drop("__bundle", "__b", "__place", "__start", "__text_key")
    )


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    narrow = materialize(docs.select("doc_id", "size", "tokens", "text_crc32", "__text_key"), "fingerprints")
    return assign(narrow, SHARDS, narrow).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op5_shards": op5_shards}

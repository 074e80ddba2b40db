"""Mixing sources to target weights by systematic sampling.

The documents of a source are put in order of size, the expected copies are
summed along that order, one random offset is added, and a document is
emitted once for each integer boundary that its interval crosses.

A document that holds much of its source can't be evened out by its
neighbours.  So the order goes through levels of size, the largest first: a
level's documents are expected ``rate`` times each, and the rate of the next
level is what the words taken so far leave to the target.  As the first rate is
target / source size and draws are without bias, every document is expected
that often over the random offset; what is missed is about one document of the lowest level.

The prefix sum has two levels.  A block is (source, level, size class, salt); ranks
within a block come from a window over that block alone, and the offsets of
blocks from the counts of blocks.  A source that holds a third of all rows
is spread over up to ``SIZE_CLASSES_PER_OCTAVE * 30 * SALTS`` blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running
from .common import discard, hash_unit, materialize, row_digest, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2.0
SALTS = 256
SIZE_CLASSES_PER_OCTAVE = 16
#: Shares of a source's words; a document above one of them is in the level before it.
LEVELS = (1 / 16, 1 / 256, 1 / 4096)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """``source, source_size, target, rate`` from ``source, size``.

    Sources in code point order, null last, take the weights in turn.  Targets
    share ``share`` times all sizes by weight; none exceeds ``cap`` times its
    source's size, what is over being dealt anew among the others.  Those at their
    cap are the first in order of size / weight: one running sum over the table of
    sources finds where the order is cut, and only that one level comes to the driver.
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    numbered = running(sums, [F.col("source").asc_nulls_last()], {"__k": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__k") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = materialize(numbered.withColumn("weight", weight), "sources")
    total, heavy = s.agg(F.sum("source_size"), F.sum("weight")).first()
    want = share * (total or 0)
    most = F.col("source_size") * cap
    summed = running(s, [most / F.col("weight"), F.col("__k")], {"__caps": most, "__weights": F.col("weight")})
    # What is left for this source and those after it, by weight; the first that doesn't reach its cap sets the level.
    left = (F.lit(want) - (F.col("__caps") - most)) / (F.lit(float(heavy or 0.0)) - F.col("__weights") + F.col("weight"))
    first = summed.filter(most / F.col("weight") > left).agg(F.min_by(left, F.col("__weights"))).first()[0]
    target = most if first is None else F.least(most, F.col("weight") * F.lit(first))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.withColumn("target", target.cast("double")).withColumn("rate", rate).drop("weight", "__k")


def _block(source_size: Column) -> list[Column]:
    octave = F.floor(F.log2(F.col("size") + 1.0) * SIZE_CLASSES_PER_OCTAVE).cast("int")
    level = sum(((F.col("size") <= source_size * x).cast("int") for x in LEVELS), F.lit(0))
    return [level.alias("__level"), (-octave).alias("__class"), F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SALTS)).cast("int").alias("__salt")]


def _crossed(rate: Column, offset: Column) -> Column:
    """Integer boundaries that a row's interval of expected copies crosses."""
    return F.floor(F.col("__place") * rate + offset) - F.floor((F.col("__place") - 1) * rate + offset)


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text")))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES, seed: str = "mix-1",
) -> DataFrame:
    """Narrow rows with ``source_size, target, copies, taken``, one for each row of ``docs``.

    Needs ``doc_id, source, size``, keeps them and ``__row``, if ``docs`` has it; other columns
    don't matter, whatever their names.  A document of size 0 (null text too) is drawn at its source's
    rate as the others are, but gives no words; in a source without words the
    rate is 0.  A null source is a source.  Rows that are equal stay rows of
    their own.  Ties in order of size fall to hashes of ``doc_id`` and ``__row``, so reruns
    agree; where all of these are equal, so are the rows.  An empty table gives none.
    """
    tie = [c for c in ("__row",) if c in docs.columns]
    narrow = materialize(docs.select("doc_id", "source", "size", *tie), "sizes")
    targets = materialize(source_targets(narrow, weights, share, cap), "targets")
    t = targets.select(F.col("source").alias("__s"), "source_size", "target", "rate")
    same = F.col("source").eqNullSafe(F.col("__s"))
    dealt = materialize(narrow.join(t.select("__s", "source_size"), same).select("doc_id", "source", "size", *tie, *_block(F.col("source_size"))), "dealt")
    blocks = dealt.groupBy("source", "__level", "__class", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("source", "__level").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        F.col("source").alias("__s"), F.col("__level").alias("__l"), F.col("__class").alias("__c"), F.col("__salt").alias("__t"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    rank = Window.partitionBy("source", "__level", "__class", "__salt").orderBy("size", F.xxhash64("doc_id", *tie), "doc_id", *tie)
    ranked = dealt.withColumn("__rank", F.row_number().over(rank)).join(
        starts, same & (F.col("__level") == F.col("__l")) & (F.col("__class") == F.col("__c")) & (F.col("__salt") == F.col("__t"))
    )
    placed = materialize(ranked.select("doc_id", "source", "size", *tie, "__level", (F.col("__before") + F.col("__rank")).alias("__place")), "placed")
    levels = placed.groupBy("source", "__level").agg(F.sum("size").alias("__words"))
    state = t.select("__s", "source_size", "target", hash_unit(F.lit(seed), F.col("__s")).alias("__offset"), F.col("rate").alias("__r0"), F.col("target").alias("__want"), F.col("source_size").alias("__rest"))
    for i in range(len(LEVELS) + 1):
        # Taken from this level at the rate that the levels before have left.
        state = materialize(state, "state")
        if i == len(LEVELS):
            break
        got = (
            placed.filter(F.col("__level") == i).join(state.select("__s", f"__r{i}", "__offset"), same)
            .groupBy("source").agg(F.sum(_crossed(F.col(f"__r{i}"), F.col("__offset")) * F.col("size")).alias("__got"))
        )
        own = levels.filter(F.col("__level") == i).select(F.col("source").alias("__o"), "__words")
        moved = (
            state.join(got, same, "left").drop("source").join(own, F.col("__s").eqNullSafe(F.col("__o")), "left")
            .withColumn("__want", F.col("__want") - F.coalesce("__got", F.lit(0))).withColumn("__rest", F.col("__rest") - F.coalesce("__words", F.lit(0)))
        )
        rate = F.when(F.col("__rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.col("__want") / F.col("__rest")))).otherwise(F.col(f"__r{i}"))
        state = moved.withColumn(f"__r{i + 1}", rate).drop("__got", "__o", "__words")
    rates = F.array(*[F.col(f"__r{i}") for i in range(len(LEVELS) + 1)])
    joined = placed.join(state.select("__s", "source_size", "target", "__offset", rates.alias("__rates")), same)
    copies = F.least(_crossed(F.get("__rates", F.col("__level")), F.col("__offset")), F.lit(int(-(-cap // 1)))).cast("int")
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    discard(narrow, dealt)
    return out.select("doc_id", "source", "size", *tie, "source_size", "target", "copies", "taken")


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; ``mixed`` is of the same rows, with their ``__row``.

    Equal rows are numbered on either side, so each meets one row of the mix.
    """
    turn = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(key))
    taken = mixed.select("__row", F.col("copies").alias("__copies")).withColumn("__turn", turn("__row")).filter("__copies > 0")
    rows = docs.withColumn("__row", row_digest("doc_id", "text")).withColumn("__turn", turn("__row"))
    met = rows.join(taken, ["__row", "__turn"])
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = sized(docs).withColumn("__row", row_digest("doc_id", "text"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mix_sources": op3_mix}

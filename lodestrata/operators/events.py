"""Event patterns: cohorts, funnels, directly-follows graphs, baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cohort(df: DataFrame, entity: str, time: str, unit: str = "month", start: str | None = None, activity: str | None = None) -> DataFrame:
    """``cohort, offset, entities``: by first event (of ``start``, if given), periods of the calendar."""
    t = F.date_trunc(unit, F.col(time))
    events = df.select(F.col(entity).alias("e"), t.alias("p"), *([F.col(activity).alias("a")] if activity else []))
    first = (events.filter(F.col("a") == start) if start else events).groupBy("e").agg(F.min("p").alias("cohort"))
    offset = {"month": F.months_between("p", "cohort").cast("int"), "week": (F.datediff("p", "cohort") / 7).cast("int"), "day": F.datediff("p", "cohort")}[unit]
    # Periods of an entity are few: they are made distinct before the join.
    return events.select("e", "p").distinct().join(first, "e").filter(F.col("p") >= F.col("cohort")).groupBy("cohort", offset.alias("offset")).agg(F.count(F.lit(1)).alias("entities"))


def retention(cells: DataFrame) -> DataFrame:
    size = F.max(F.when(F.col("offset") == 0, F.col("entities"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("rate", F.col("entities") / size)


def funnel(df: DataFrame, entity: str, activity: str, time: str, stages: Sequence[str], within_seconds: int) -> DataFrame:
    """``stage, entities``: entities that get so far, each stage after the one before, within the time from their first stage 0.

    One minimum a stage and entity: aggregates and joins on the entity, all on the same partitioning.
    """
    t = F.col(time).cast("timestamp").cast("double")
    e = df.filter(F.col(activity).isin(list(stages))).select(F.col(entity).alias("e"), F.col(activity).alias("a"), t.alias("t"))
    reached = e.filter(F.col("a") == stages[0]).groupBy("e").agg(F.min("t").alias("t0")).withColumn("last", F.col("t0"))
    out = reached.agg(F.lit(0).alias("stage"), F.lit(stages[0]).alias("activity"), F.count(F.lit(1)).alias("entities"))
    for i, s in enumerate(stages[1:], 1):
        nxt = e.filter(F.col("a") == s).select(F.col("e").alias("e2"), F.col("t").alias("t2"))
        reached = (
            reached.join(nxt, (F.col("e") == F.col("e2")) & (F.col("t2") > F.col("last")) & (F.col("t2") < F.col("t0") + within_seconds))
            .groupBy("e", "t0").agg(F.min("t2").alias("last"))
        )
        out = out.unionByName(reached.agg(F.lit(i).alias("stage"), F.lit(s).alias("activity"), F.count(F.lit(1)).alias("entities")))
    return out


def follows(df: DataFrame, case: str, activity: str, order: Sequence[str]) -> DataFrame:
    """``source, target, n``: how often one activity comes right after another in a case."""
    w = Window.partitionBy(case).orderBy(*order)
    return df.select(F.col(activity).alias("source"), F.lead(activity).over(w).alias("target")).filter("target is not null").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def case_ends(df: DataFrame, case: str, activity: str, order: Sequence[str]) -> DataFrame:
    """``activity, starts, ends`` over cases."""
    key = F.struct(*order)
    ends = df.groupBy(case).agg(F.min_by(activity, key).alias("s"), F.max_by(activity, key).alias("e"))
    both = ends.select(F.explode(F.array(F.struct(F.col("s").alias("activity"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct(F.col("e").alias("activity"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))).alias("x"))
    return both.groupBy("x.activity").agg(F.sum("x.starts").alias("starts"), F.sum("x.ends").alias("ends"))


def conformance(df: DataFrame, case: str, activity: str, order: Sequence[str], starts: Sequence[str], edges: Sequence[tuple[str, str]], ends: Sequence[str]) -> DataFrame:
    """``case, steps, broken, fits``: against allowed starts, adjacent pairs and ends."""
    w = Window.partitionBy(case).orderBy(*order)
    a, nxt, before = F.col(activity), F.lead(activity).over(w), F.lag(activity).over(w)
    rows = df.select(case, a.alias("a"), nxt.alias("n"), before.alias("b"))
    allowed = F.concat_ws("\u0001", "a", "n").isin([f"{x}\u0001{y}" for x, y in edges])
    broken = (F.col("n").isNotNull() & ~allowed).cast("int") + (F.col("b").isNull() & ~F.col("a").isin(list(starts))).cast("int") + (F.col("n").isNull() & ~F.col("a").isin(list(ends))).cast("int")
    return rows.groupBy(case).agg(F.count(F.lit(1)).alias("steps"), F.sum(broken).alias("broken")).withColumn("fits", F.col("broken") == 0)


def baskets(df: DataFrame, transaction: str, item: str) -> DataFrame:
    """``transaction, items``: distinct items, empty for transactions without any."""
    return df.groupBy(transaction).agg(F.array_sort(F.collect_set(item)).alias("items"))


def frequent_sets(df: DataFrame, transaction: str, item: str, support: float, largest: int = 3) -> DataFrame:
    """``items, n, support`` of sets that a share of all transactions (empty ones too) holds.

    Level by level: candidates of size k join the items that are frequent,
    so rows that can't count are gone before pairs are made.
    """
    pairs = df.select(F.col(transaction).alias("t"), F.col(item).alias("i")).distinct()
    n = pairs.select("t").distinct().count()
    least = support * n - 1e-9
    pairs = pairs.filter("i is not null")
    single = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rows = pairs.join(single.select("i"), "i")
    sets, out = rows.select("t", F.array("i").alias("items")), None
    for k in range(1, largest + 1):
        counts = sets.groupBy("items").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        out = counts if out is None else out.unionByName(counts)
        if k < largest:
            kept = sets.join(counts.select("items"), "items")
            sets = kept.join(rows, "t").filter(F.col("i") > F.element_at("items", -1)).select("t", F.concat("items", F.array("i")).alias("items"))
    return out.withColumn("support", F.col("n") / n)


def rules(sets: DataFrame, transactions: int, confidence: float) -> DataFrame:
    """``antecedent, consequent, support, confidence, lift``; either side may have several items."""
    big = sets.filter(F.size("items") > 1).select("items", F.col("n").alias("both"))
    masks = big.withColumn("m", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("items")) - 2).cast("int"))))
    bit = lambda on: F.filter("items", lambda x, i: (F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1)) == (1 if on else 0)))
    split = masks.select("both", bit(True).alias("antecedent"), bit(False).alias("consequent"))
    a, c = sets.select(F.col("items").alias("antecedent"), F.col("n").alias("na")), sets.select(F.col("items").alias("consequent"), F.col("n").alias("nc"))
    conf = F.col("both") / F.col("na")
    return split.join(a, "antecedent").join(c, "consequent").select("antecedent", "consequent", (F.col("both") / transactions).alias("support"), conf.alias("confidence"), (conf / (F.col("nc") / transactions)).alias("lift")).filter(F.col("confidence") >= confidence)

"""Drift between a reference and a current sample, delayed labels, scores of predictions and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import dtype, finite
from .running import in_ranges, quantiles, running, with_next


def _both(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    pick = lambda d, k: d.filter(finite(F.col(column), dtype(d, column))).select(F.col(column).cast("double").alias("v"), F.lit(k).alias("k"))
    return pick(reference, 0).unionByName(pick(current, 1))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability: bins at the reference's quantiles, open at both ends, counts plus a half."""
    cuts = quantiles(reference, F.when(finite(F.col(column), dtype(reference, column)), F.col(column)), [i / bins for i in range(1, bins)])
    edges = sorted({c for c in cuts if c is not None})
    both = _both(reference, current, column)
    k = F.lit(0)
    for e in edges:
        k = k + (F.col("v") > e).cast("int")
    cells = both.groupBy(k.alias("b")).agg(F.count(F.when(F.col("k") == 0, 1)).alias("r"), F.count(F.when(F.col("k") == 1, 1)).alias("c"))
    # Bins without rows on either side add ln(1): they count for the totals only.
    n = len(edges) + 1
    tot = cells.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("have"))
    p, q = (F.col("r") + 0.5) / (F.col("nr") + 0.5 * n), (F.col("c") + 0.5) / (F.col("nc") + 0.5 * n)
    p0, q0 = 0.5 / (F.first("nr") + 0.5 * n), 0.5 / (F.first("nc") + 0.5 * n)
    return cells.join(F.broadcast(tot)).agg((F.sum((q - p) * F.log(q / p)) + (n - F.first("have")) * (q0 - p0) * F.log(q0 / p0)).alias("psi"))


def _merged(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """``v, fr, fc, gap`` over distinct values: both distribution functions, and the distance to the next value."""
    c = _both(reference, current, column).groupBy("v").agg(F.count(F.when(F.col("k") == 0, 1)).alias("r"), F.count(F.when(F.col("k") == 1, 1)).alias("c"))
    nr, nc = c.agg(F.sum("r"), F.sum("c")).first()
    upto = running(with_next(c, F.col("v"), "next"), [F.col("v")], {"__r_upto": F.col("r"), "__c_upto": F.col("c")})
    return upto.select("v", (F.col("__r_upto") / float(nr or 1)).alias("fr"), (F.col("__c_upto") / float(nc or 1)).alias("fc"), (F.col("next") - F.col("v")).alias("gap"))


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    return _merged(reference, current, column).agg(F.max(F.abs(F.col("fr") - F.col("fc"))).alias("ks"))


def wasserstein(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    return _merged(reference, current, column).agg(F.sum(F.abs(F.col("fr") - F.col("fc")) * F.col("gap")).alias("wasserstein"))


def category_drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """``js_distance`` (base 2) and the number of values that the reference hasn't."""
    pick = lambda d, k: d.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.lit(k).alias("k"))
    c = pick(reference, 0).unionByName(pick(current, 1)).groupBy("v").agg(F.count(F.when(F.col("k") == 0, 1)).alias("r"), F.count(F.when(F.col("k") == 1, 1)).alias("c"))
    t = c.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    p, q = F.col("r") / F.col("nr"), F.col("c") / F.col("nc")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return c.join(F.broadcast(t)).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part(p) + part(q)) / 2)).alias("js_distance"), F.count(F.when(F.col("r") == 0, 1)).alias("unseen"))


def delayed(predictions: DataFrame, labels: DataFrame, key: str, as_of: str, delay: str) -> DataFrame:
    """``matched, waiting, overdue``: labels count once they have arrived (``arrived`` ≤ ``as_of``)."""
    now = F.lit(as_of).cast("timestamp")
    got = predictions.join(labels.filter(F.col("arrived") <= now).select(key, "arrived"), key, "left")
    late = F.col("at") + F.expr(f"interval {delay}") < now
    none = F.col("arrived").isNull()
    return got.agg(F.count("arrived").alias("matched"), F.count(F.when(none & ~late, 1)).alias("waiting"), F.count(F.when(none & late, 1)).alias("overdue"))


def binary_metrics(df: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion, precision, recall, F1, Brier and the area under the ROC curve (ties count half)."""
    y, s = F.col(truth).cast("int"), F.col(score)
    p = (s >= threshold).cast("int")
    n = lambda a, b: F.count(F.when((y == a) & (p == b), 1))
    base = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"), F.avg((s - y) * (s - y)).alias("brier"))
    cells = df.groupBy(s.alias("s")).agg(F.sum(y).alias("pos"), (F.count(F.lit(1)) - F.sum(y)).alias("neg"))
    upto = running(cells, [F.col("s")], {"upto": F.col("neg")})
    pairs = upto.select("pos", "neg", (F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("w"))
    auc = pairs.agg((F.sum("w") / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return base.join(F.broadcast(auc)).select("tp", "fp", "fn", "tn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), "brier", "roc_auc")


def calibration(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    cells = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(truth).cast("double")).alias("frequency"))
    return cells


def expected_calibration_error(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    return calibration(df, truth, score, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("frequency"))) / F.sum("n")).alias("ece"))


def ranking_metrics(recommended: DataFrame, relevant: DataFrame, user: str, item: str, rank: str, k: int) -> DataFrame:
    """Per user: precision (of k), recall, NDCG and average precision at k; recall is null without relevant items."""
    hits = recommended.filter(F.col(rank) <= k).join(relevant.select(user, item, F.lit(1).alias("hit")).distinct(), [user, item], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    order = Window.partitionBy(user).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("found", F.sum("hit").over(order))
    per = rows.groupBy(user).agg(F.sum("hit").alias("h"), F.sum(F.col("hit") / F.log2(F.col(rank) + 1.0)).alias("dcg"), F.sum(F.col("hit") * F.col("found") / F.col(rank)).alias("ap"))
    want = relevant.groupBy(user).agg(F.count_distinct(item).alias("r"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("r"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return per.join(want, user, "left").select(user, (F.col("h") / k).alias("precision"), (F.col("h") / F.col("r")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("ap") / F.least(F.col("r"), F.lit(k))).alias("ap"))


def slices(df: DataFrame, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Accuracy, selection and true positive rates of groups: what fairness reports compare."""
    y, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((y == p).cast("double")).alias("accuracy"), F.avg(p.cast("double")).alias("selection_rate"), F.avg(F.when(y == 1, p.cast("double"))).alias("true_positive_rate"))


def conformal_width(df: DataFrame, truth: str, predicted: str, level: float = 0.9) -> DataFrame:
    """Half width of a split-conformal interval: the ceil((n + 1) level)-th smallest absolute residual."""
    r = df.select(F.abs(F.col(truth) - F.col(predicted)).alias("r")).filter("r is not null")
    n = r.count()
    k = -(-int(round((n + 1) * level * 1e9)) // 10**9)
    return r.orderBy("r").offset(min(k, n) - 1).limit(1).select(F.col("r").alias("half_width"))


def page_hinkley(df: DataFrame, order: str, value: str, slack: float, threshold: float) -> DataFrame:
    """``order, statistic, alarm``: how far the sum of deviations from the running mean (less ``slack`` each) is above its lowest so far.

    ``order`` must tell rows apart.  Sums and the minimum are taken in ranges of the order.
    """
    x = F.col(value).cast("double")
    upto = running(df.select(F.col(order).alias("order"), x.alias("x")), [F.col("order")], {"n": F.lit(1), "s": F.col("x")})
    deviations = running(upto.select("order", (F.col("x") - F.col("s") / F.col("n") - slack).alias("d")), [F.col("order")], {"m": F.col("d")})
    low = running_min(deviations.select("order", "m"), "order", "m", "low")
    return low.select("order", (F.col("m") - F.least("low", F.lit(0.0))).alias("statistic")).withColumn("alarm", F.col("statistic") > threshold)


def running_min(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the least value up to each row, in ranges of the order."""
    ranged = in_ranges(df, [F.col(order)])
    lows = ranged.groupBy(F.col("__range").alias("__r")).agg(F.min(value).alias("__low"))
    before = lows.select("__r", F.min("__low").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)).alias("__low"))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), F.col("__range") == F.col("__r"))
    return out.withColumn(name, F.least(F.min(value).over(within), F.col("__low"))).drop("__range", "__r", "__low")

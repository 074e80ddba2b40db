"""URL filter: ratio of two character language models, beside longest-match rules.

URLs that an allow rule fits train the model of accepted URLs, those that a
block rule fits that of rejected ones.  Both are variable-order Markov models:
counts of character runs of up to ``ORDER + 1`` characters, each order smoothed
by the one below it, so that the longest context that has been seen decides.
Counts are exact, in a table by run that grows with the input.  What a character
adds to a score depends only on its window, the longest run that ends there;
so a table of all distinct windows is made, and each URL's windows are joined
to it.  Frequent keys of both tables are broadcast, the others shuffled.  The
score is the difference of the two log likelihoods, divided by the number of
characters; the threshold is where, on a fifth of the labelled URLs that the
counts leave out, the two error rates together are least.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 4
STRENGTH = 2.0
FOLDS = 5
BINS_PER_UNIT, LIMIT = 50, 20
#: A key with over 1 / HOT of all rows is looked up by broadcast: at most HOT keys, and no others have more.
HOT = 20_000
#: Parts of a whole score that a window's share is rounded to, so that sums don't depend on their order.
UNIT = 1e-9


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null.  A rule fits its host and all subdomains, if the path starts with its path."""
    found = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though its expression would be repeated within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chars(url: Column) -> Column:
    """Characters with a start and an end mark; digits count as one character."""
    plain = F.translate(ascii_lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    return F.concat(F.array(F.lit("\u0002")), F.filter(F.split(plain, ""), lambda c: c != ""), F.array(F.lit("\u0003")))


def _windows(chars: Column) -> Column:
    """For each character the run of up to ``ORDER + 1`` characters that ends there."""
    return F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.array_join(F.slice(chars, F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))), ""))


def _slots(w: Column) -> Column:
    """Runs that end a window, shortest first, and from ``ORDER + 1`` on the contexts of those of two characters or more."""
    n = F.char_length(w)
    runs = [(k, n > k, F.substr(w, n - k, F.lit(k + 1))) for k in range(ORDER + 1)]
    contexts = [(ORDER + k, n > k, F.substr(w, n - k, F.lit(k))) for k in range(1, ORDER + 1)]
    return F.filter(F.array(*[F.struct(F.lit(j).alias("slot"), F.when(there, run).alias("run")) for j, there, run in runs + contexts]), lambda x: x["run"].isNotNull())


def _log_ratio(run, context, totals: tuple[int, int]) -> Column:
    """What a character adds; ``run(k, side)`` and ``context(k, side)`` are counts, 0 for runs that would begin before the start."""
    logs = []
    for side in (0, 1):
        p = F.lit(1.0 / 256)
        for k in range(ORDER + 1):
            c = context(k, side) if k else F.lit(totals[side])
            p = (F.least(run(k, side), c) + p * STRENGTH) / (c + STRENGTH)
        logs.append(F.log(p))
    return logs[0] - logs[1]


def _look_up(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Inner join to a table with one row a key and the number ``n`` of rows that have it."""
    total = found.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total / HOT
    hot, cold = F.broadcast(found.filter(often).drop("n")), found.filter(~often).drop("n")
    # Without a hint on the side that is left, Spark broadcasts it too where it is small.
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key).select(*rows.columns, *[c for c in hot.columns if c != key]))


class Model:
    """Exact counts ``run, a, r`` of runs in accepted and rejected URLs, and the threshold."""

    def __init__(self, counts: DataFrame, totals: tuple[int, int], threshold: float = 0.0):
        self.counts, self.totals, self.threshold = counts, totals, threshold

    def score(self, url: Column) -> Column:
        """Mean log likelihood ratio of a character; above 0 the model of accepted URLs fits better.

        The counts become a literal, so this is for small models; ``judge`` joins tables.
        """
        if not all(self.totals):
            return F.lit(0.0)
        known = {r.run: [r.a, r.r] for r in self.counts.filter("a + r > 0").collect()}
        counts = F.from_json(F.lit(json.dumps(known)), "map<string, array<bigint>>")

        def share(w: Column) -> Column:
            def use(found: Column) -> Column:
                return _log_ratio(lambda k, side: F.coalesce(F.get(F.get(found, F.lit(k)), F.lit(side)), F.lit(0)), lambda k, side: F.coalesce(F.get(F.get(found, F.lit(ORDER + k)), F.lit(side)), F.lit(0)), self.totals)

            n = F.char_length(w)
            runs = [F.when(n > k, F.substr(w, n - k, F.lit(k + 1))) for k in range(ORDER + 1)] + [F.when(n > k, F.substr(w, n - k, F.lit(k))) for k in range(1, ORDER + 1)]
            return _bound(F.transform(F.array(*runs), lambda x: F.try_element_at(counts, x)), use)

        each = _bound(_chars(url), _windows)
        return _bound(each, lambda ws: F.aggregate(F.transform(ws, share), F.lit(0.0), lambda acc, x: acc + x) / F.size(ws))


def _learn(rows: DataFrame) -> tuple[DataFrame, Model]:
    """``__id, score`` of all rows of ``__id, url, accepted`` (null: without a rule), and the model of the labelled ones."""
    fold = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(FOLDS))
    each = rows.select("__id", F.when(fold != 0, F.col("accepted")).alias("__side"), F.explode(_bound(_chars(F.col("url")), _windows)).alias("w"))
    windows = materialize(each.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__side"), 1)).alias("a"), F.count(F.when(~F.col("__side"), 1)).alias("r")), "windows")
    # Every character ends one window.
    totals = tuple(x or 0 for x in windows.agg(F.sum("a"), F.sum("r")).first())
    parts = windows.select("w", "a", "r", F.explode(_slots(F.col("w"))).alias("x")).select("w", "a", "r", "x.slot", "x.run")
    own = lambda c: F.sum(F.when(F.col("slot") <= ORDER, F.col(c)).otherwise(0)).alias(c)
    counts = materialize(parts.groupBy("run").agg(F.count(F.lit(1)).alias("n"), own("a"), own("r")), "runs")
    model = Model(counts, totals)
    if not all(totals):
        return rows.select("__id", F.lit(0.0).alias("score")), model
    placed = _look_up(parts.select("w", "slot", "run"), counts, "run")
    held = [(c, j) for c in ("a", "r") for j in range(2 * ORDER + 1)]
    wide = placed.groupBy("w").agg(*[F.coalesce(F.max(F.when(F.col("slot") == j, F.col(c))), F.lit(0)).alias(f"{c}{j}") for c, j in held])
    share = _log_ratio(lambda k, side: F.col(f"{'ar'[side]}{k}"), lambda k, side: F.col(f"{'ar'[side]}{ORDER + k}"), totals)
    shares = materialize(wide.select("w", F.round(share / UNIT).cast("bigint").alias("share")).join(windows.select("w", "n"), "w"), "shares")
    summed = _look_up(each.select("__id", "w"), shares, "w").groupBy("__id").agg((F.sum("share") * UNIT / F.count(F.lit(1))).alias("score"))
    scores = materialize(summed, "scores")
    bin_ = F.round(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.col("score"))) * BINS_PER_UNIT).cast("int")
    tested = rows.filter((fold == 0) & F.col("accepted").isNotNull()).join(scores, "__id")
    histogram = sorted(tuple(r) for r in tested.groupBy(bin_.alias("b")).agg(F.count(F.when(F.col("accepted"), 1)), F.count(F.when(~F.col("accepted"), 1))).collect())
    good, bad = sum(r[1] for r in histogram), sum(r[2] for r in histogram)
    if good and bad:
        lost, stopped, best = 0, 0, []
        for (b, g, x), after in zip(histogram, [*histogram[1:], (histogram[-1][0] + 2, 0, 0)], strict=True):
            lost, stopped = lost + g, stopped + x
            cut = (b + after[0]) / 2 / BINS_PER_UNIT
            best.append((lost / good + 1 - stopped / bad, abs(cut), cut))
        model.threshold = min(best)[2]
    return scores, model


def _numbered(rows: DataFrame) -> DataFrame:
    """Written with an id a row, so that the ids stay."""
    return materialize(rows.withColumn("__id", F.monotonically_increasing_id()), "rows")


def fit(labelled: DataFrame) -> Model:
    """From all rows of ``url, accepted`` (boolean): counts on four folds, the threshold on the fifth.

    Without URLs of both kinds every score is 0 and passes.
    """
    return _learn(_numbered(labelled.select("url", "accepted")))[1]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds ``host, path, rule, score, verdict`` to rows with a ``url``.

    A null URL, or one without ``://``, has no host or path, so no rule fits
    it and the model judges its characters.  Equal URLs are judged alike; an
    empty table gives none.
    """
    kinds = F.create_map(*[F.lit(x) for kind, text in rules for x in (text, kind)])
    found = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    found = found.withColumn("rule", rule(F.col("host"), F.col("path"), rules)).withColumn("__kind", F.try_element_at(kinds, F.col("rule")))
    rows = _numbered(found.withColumn("accepted", F.col("__kind") == "allow"))
    scores, model = _learn(rows.select("__id", "url", "accepted"))
    return (
        rows.join(scores, "__id")
        .withColumn("verdict", F.coalesce("__kind", F.when(F.col("score") >= model.threshold, F.lit("allow")).otherwise(F.lit("block"))))
        .drop("__kind", "__id", "accepted")
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op4_urls": op4_urls}

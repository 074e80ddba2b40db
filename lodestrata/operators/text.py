"""Text analytics: tokens, vocabulary, TF-IDF, similarity."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def tokens(c: Column, numbers: bool = False, stop: Sequence[str] = (), n: int = 1, turkish: bool = False) -> Column:
    """Array of lower-case runs of letters and marks (digits too with ``numbers``); null has none; n-grams joined by a space."""
    text = F.translate(c, "Iİ", "ıi") if turkish else c
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+" if numbers else r"[\p{L}\p{M}]+"), F.lit(0))
    if stop:
        found = F.filter(found, lambda t: ~t.isin([s.lower() for s in stop]))
    if n == 1:
        return found
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(found, i, n), " ")) if n > 1 else found


def term_counts(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """``doc, term, tf``; terms of a document combine before the shuffle."""
    n = options.get("n", 1)
    rows = df.select(F.col(key).alias("doc"), F.explode(tokens(F.col(text), **options)).alias("term"))
    if n > 1:
        rows = rows.filter(F.size(F.split("term", " ")) == n)
    return rows.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, limit: int) -> DataFrame:
    """``term, count, df`` of the most frequent terms, ties in the order of terms."""
    return counts.groupBy("term").agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df")).orderBy(F.col("count").desc(), "term").limit(limit)


def tfidf(df: DataFrame, key: str, text: str, limit: int = 5000, **options) -> DataFrame:
    """``doc, term, weight``: tf * (ln((1 + n) / (1 + df)) + 1), each document of length 1."""
    # Kept, as both the vocabulary and the weights need them: texts are cut into terms once.
    counts = cut(term_counts(df, key, text, **options))
    n = df.count()
    vocab = vocabulary(counts, limit)
    raw = counts.join(vocab.select("term", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")), "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    # Over a window, so that terms are dealt out by document once; a null names no document.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.filter("doc is not null").select("doc", "term", (F.col("w") / norm).alias("weight"))


#: Terms up to which their counts go to all tasks, so that weights needn't be dealt out by term.
SENT_TERMS = 1 << 18
#: Parts of the vocabulary whose lengths in a document bound its cosine with others.
PARTS = 8


def _release(df: DataFrame) -> None:
    """Lets Spark remove shuffle files of jobs whose results are written, which it does when the driver collects its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _all_scored(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    left = pairs.join(weights.select(F.col("doc").alias("a"), "term", F.col("weight").alias("wa")), "a")
    both = left.join(weights.select(F.col("doc").alias("b"), "term", F.col("weight").alias("wb")), ["b", "term"])
    return both.groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 12).alias("cosine"))


def _closest(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.col("cosine").desc(), "a", "b").limit(limit)


def _meeting(rows: DataFrame, bound: float) -> DataFrame:
    """Pairs ``a, b`` that share a term of ``rows`` (``doc, term, weight, parts``) and may reach the cosine ``bound``.

    Documents have length 1, so two that reach it are at most ``sqrt(2 - 2 bound)`` apart, and so are their weights of a term; they
    meet in ranges of weights so wide.  The products of their lengths in each part of the vocabulary sum to their cosine at least.
    """
    apart = max(2 - 2 * bound, 0.0) ** 0.5 + 1e-6
    cell = F.floor(F.col("weight") / apart)
    a = rows.select(F.col("doc").alias("a"), "term", cell.alias("cell"), F.col("parts").alias("pa"))
    b = rows.select(F.col("doc").alias("b"), "term", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), F.col("parts").alias("pb"))
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, ["term", "cell"]).filter(F.col("a") < F.col("b")).filter(most >= bound - 1e-9).select("a", "b").distinct()


def similar(weights: DataFrame, limit: int = 30, most_documents: int = 1000) -> DataFrame:
    """``a, b, cosine`` of the closest of all pairs that share a term; documents have length 1, as ``tfidf`` gives them.

    Documents with equal weights form a class, and the first of each are compared; in the order of the result a class's pairs
    start with its first documents, so ``limit`` closest pairs of classes and ``limit + 1`` documents of each give it.
    Neighbours among documents with the same heaviest terms (of those in at most
    ``most_documents`` documents) only give a lower bound of the last cosine.  A
    pair that reaches it shares a term among those that a document's weights,
    rarest term first, need to reach it: what is left of either is shorter than
    the bound.
    """
    _release(weights)
    weights = cut(weights.filter(F.col("doc").isNotNull()))
    _release(weights)
    square = F.col("weight") * F.col("weight")
    part = F.pmod(F.xxhash64(F.lit(3), "term"), F.lit(PARTS))
    docs = cut(
        weights.groupBy("doc").agg(
            *[F.bit_xor(F.xxhash64(F.lit(k), "term", "weight")).alias(f"h{k}") for k in (1, 2)], F.round(F.sum(square), 12).alias("cosine"),
            F.array(*[F.sqrt(F.sum(F.when(part == k, square).otherwise(0.0))) for k in range(PARTS)]).alias("parts"),
        )
    )
    ranked = docs.withColumn("at", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("doc"))).filter(F.col("at") <= limit + 1)
    members = cut(ranked.withColumn("rep", F.first("doc").over(Window.partitionBy("h1", "h2").orderBy("doc"))))
    firsts = members.filter("at = 1").select("doc", "parts")
    weights = cut(weights.join(firsts.select("doc"), "doc", "left_semi"))
    _release(weights)
    listed = members.select("rep", F.col("doc").alias("member"))
    inside = _closest(members.filter("at = 2").select(F.col("rep").alias("a"), F.col("rep").alias("b"), "cosine"), limit)

    def expanded(classes: DataFrame) -> DataFrame:
        x, y = (listed.select(F.col("rep").alias(c), F.col("member").alias(f"m{c}")) for c in "ab")
        met = classes.join(x, "a").join(y, "b").filter((F.col("a") != F.col("b")) | (F.col("ma") < F.col("mb")))
        return _closest(met.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), "cosine"), limit)

    df_ = cut(weights.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    df_ = F.broadcast(df_) if df_.count() <= SENT_TERMS else df_
    found = expanded(inside).agg(F.count(F.lit(1)), F.min("cosine")).first()
    if found[0] < limit:
        rare = weights.join(df_.filter(F.col("n").between(2, most_documents)).select("term"), "term")
        heaviest = rare.groupBy("doc").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("weight", "term")))), 1, 3).alias("top"))
        alike = heaviest.select("doc", F.explode(F.transform(F.sequence(F.lit(1), F.size("top")), lambda k: F.array_join(F.transform(F.slice("top", F.lit(1), k), lambda x: x["term"]), " "))).alias("same"))
        near = cut(alike.select(F.lag("doc").over(Window.partitionBy("same").orderBy("doc")).alias("a"), F.col("doc").alias("b")).filter("a < b").distinct())
        found = expanded(_closest(_all_scored(near, weights), limit).unionByName(inside)).agg(F.count(F.lit(1)), F.min("cosine")).first()
    bound = found[1] - 1e-9 if found[0] >= limit else 0.0
    rest = F.sqrt(F.sum(square).over(Window.partitionBy("doc").orderBy(F.col("n").desc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    needed = weights.join(df_, "term").withColumn("rest", rest).filter((F.col("rest") >= bound) & (F.col("n") > 1)).join(firsts, "doc")
    _release(weights)
    pairs = cut(_meeting(needed.select("doc", "term", "weight", "parts"), bound))
    _release(weights)
    return expanded(_closest(_all_scored(pairs, weights), limit).unionByName(inside))


def search(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """``key, cosine`` of the k vectors closest to one given."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    return df.select(key, (dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))).alias("cosine")).orderBy(F.col("cosine").desc(), key).limit(k)


def entities(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, entity, n``: dictionary terms (``entity, term``, one word each) found in texts."""
    rows = df.select(key, F.explode(tokens(F.col(text), numbers=True)).alias("term"))
    return rows.join(names.select("entity", F.lower("term").alias("term")), "term").groupBy(key, "entity").agg(F.count(F.lit(1)).alias("n"))

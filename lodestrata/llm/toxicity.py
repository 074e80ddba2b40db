"""Toxicity of texts that may be disguised: a noisy channel undone, then a classifier.

A character trigram model is counted over all documents.  A token that may be
disguised (signs or digits among letters, letters twice in a row, single letters
or signs set apart by any separators) becomes a lattice: each sign stands for itself or for a
letter, a repeated letter may be one too many, a separator may be deleted.
The likeliest path through the lattice under channel and language model is
found by Viterbi search, and the restored text is scored by logistic
regression on the words and word beginnings that occur in it.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

#: Bound of the labelled rows that the fit reads, and of the features that it keeps.
TRAIN_ROWS, FEATURES_KEPT = 20_000, 4_096
CLASSES, BOUNDARY, OTHER = 64, 0, 63
FEATURE_BITS = 22
# Letters that signs and digits stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou",
}
SEPARATORS = " .-_*~'`/\\,"
#: Log costs of the channel.
STANDS_FOR, WILD, DROP_REPEAT, KEEP_THIRD, DROP_SEPARATOR = -0.7, -2.0, -0.7, -4.0, -0.7
PAIR_WEIGHT = 5.0
_SIGNS = "".join(re.escape(c) for c in LEET if not c.isdigit())
# One character of a disguised word; ``*`` is left to the separators, so that no text is divided in two ways.
_ONE = rf"(?:[^\W_]|[{_SIGNS.replace(re.escape('*'), '')}])"
_BETWEEN = f"[{re.escape(SEPARATORS)}]+"
SPACED = re.compile(rf"(?<!\S)(?:{_ONE}{_BETWEEN}){{2,}}{_ONE}(?![^\s.,;:!?])")
SUSPECT = re.compile(rf"[^\W\d_][{_SIGNS}\d]|[{_SIGNS}\d][^\W\d_]|([^\W\d_])\1|{_ONE}{_BETWEEN}{_ONE}{_BETWEEN}{_ONE}")
LETTER = re.compile(r"[^\W\d_]")
#: Signs that end a word without being part of it; of dollar signs it takes three.
TRAILING = "!?#%&*.,;:\"')]}|"
#: Of a longer run of one character three are left: a fourth says no more about the word.
LONG_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)


def classes_of(text: str) -> np.ndarray:
    """Class of each character: a boundary, one of a-z, one of 36 for other letters, or other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((codes >= 97) & (codes <= 122), codes - 96, 27 + codes % 36)
    ascii_rest = (codes < 128) & ~((codes >= 97) & (codes <= 122))
    out = np.where(ascii_rest, OTHER, out)
    return np.where((codes == 32) | (codes >= 9) & (codes <= 13), BOUNDARY, out).astype(np.int64)


def class_of(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return BOUNDARY if c.isspace() else OTHER if ord(c) < 128 else 27 + ord(c) % 36


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probability of a class after two others, smoothed by shorter contexts; counts are over all texts."""

    def count(t: pa.Table) -> pa.Table:
        # All texts of the slice at once, so that the table of counts is gone through once.
        parts = [np.zeros(2, np.int64)]
        for s in t.column("__text").to_pylist():
            if s:
                parts += [classes_of(s.lower()), np.zeros(2, np.int64)]
        c = np.concatenate(parts)
        total = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        return pa.table({"g": at, "n": total[at]})

    rows = map_arrow(docs.select(F.col(text).alias("__text")), count, "g bigint, n bigint", 1000)
    got = rows.groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(CLASSES**3)
    three[got.column("g").to_numpy()] = got.column("n").to_numpy()
    three = three.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + PAIR_WEIGHT * p1) / (two.sum(axis=1, keepdims=True) + PAIR_WEIGHT)
    p3 = (three + PAIR_WEIGHT * p2[None]) / (three.sum(axis=2, keepdims=True) + PAIR_WEIGHT)
    return np.log(p3).astype(np.float32).ravel()


def without_trailing(token: str) -> str:
    while True:
        cut = token.rstrip(TRAILING)
        if cut.endswith("$$$"):
            cut = cut.rstrip("$")
        if cut == token:
            return cut
        token = cut


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character of a lower-case token what may have been sent (one letter or nothing), with its log cost."""
    run, out = 0, []
    for i, c in enumerate(token):
        run = run + 1 if i and token[i - 1] == c else 1
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, KEEP_THIRD if run > 2 else 0.0))
            if run > 1:
                options.append(("", DROP_REPEAT if run == 2 else 0.0))
        else:
            options.append((c, 0.0))
            stands = LEET.get(c, "")
            options += [(x, WILD if len(stands) > 2 else STANDS_FOR) for x in stands]
            if c in SEPARATORS or run > 1:
                options.append(("", DROP_SEPARATOR))
        out.append(options)
    return out


def restore(token: str, logp: list[float]) -> str:
    """The likeliest original of a lower-case token, which may hold spaces."""
    # State: classes of the last two characters sent; value: log probability, and what was sent as a chain to the start.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(BOUNDARY, BOUNDARY): (0.0, None)}
    for options in lattice(token):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        known = [(out, class_of(out) if out else 0, cost) for out, cost in options]
        for (a, b), (score, sent) in paths.items():
            for out, k, cost in known:
                if out:
                    state, value, chain = (b, k), score + cost + logp[(a * CLASSES + b) * CLASSES + k], (out, sent)
                else:
                    state, value, chain = (a, b), score + cost, sent
                if state not in following or value > following[state][0]:
                    following[state] = (value, chain)
        paths = following
    chain = max(((score + logp[(a * CLASSES + b) * CLASSES + BOUNDARY], sent) for (a, b), (score, sent) in paths.items()), key=lambda x: x[0])[1]
    letters = []
    while chain:
        letters.append(chain[0])
        chain = chain[1]
    return "".join(reversed(letters))


def _id(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}{s}".encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS)


class Features(dict):
    """Feature ids of a token as it stands in a text; kept for tokens seen before.  With ``only``, ids outside it are left out."""

    def __init__(self, logp: np.ndarray, only: dict[int, float] | None = None):
        super().__init__()
        self.logp, self.only = logp.tolist(), only

    def word(self, w: str) -> list[int]:
        out = [_id("w", w)]
        out += [_id(f"p{k}", w[:k]) for k in (3, 4, 5, 6) if len(w) > k]
        return out if self.only is None else [i for i in out if i in self.only]

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        plain = without_trailing(token.lower()).lstrip("\"'([{.,;:")
        ids: list[int] = []
        for w in self.restored(plain).split():
            ids += self.word(w.strip(".,;:!?\"'()[]{}"))
        found = self[token] = tuple(ids)
        return found

    def restored(self, plain: str) -> str:
        return restore(LONG_RUN.sub(r"\1\1\1", plain), self.logp) if SUSPECT.search(plain) and LETTER.search(plain) else plain

    def of_text(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: set[int] = set()
        for w in set(text.split()):
            if own := self[w]:
                ids.update(own)
        for m in SPACED.finditer(text):
            if not LETTER.search(m[0]):
                continue
            for w in restore(LONG_RUN.sub(r"\1\1\1", m[0].lower()), self.logp).split():
                ids.update(self.word(w))
        return sorted(ids)


def fit_linear(rows: list[np.ndarray], y: np.ndarray, size: int, ridge: float = 5e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature numbers below ``size``.

    Accelerated steps, each coordinate with its own rate from a separable bound of the curvature.
    """
    w, b = np.zeros(size), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -10.0
    if not len(y):
        return w, b
    lengths = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    col = np.concatenate(rows).astype(np.int64)
    held = (lengths + 1.0) / len(y) / 4
    rate, rate_b = 1 / (np.bincount(col, weights=held[row], minlength=size) + ridge), 1 / held.sum()
    last_w, last_b = w, b
    for step in range(steps):
        m = step / (step + 3)
        vw, vb = w + m * (w - last_w), b + m * (b - last_b)
        z = vb + np.bincount(row, weights=vw[col], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        last_w, last_b = w, b
        w = vw - rate * (np.bincount(col, weights=g[row], minlength=size) + ridge * vw)
        b = vb - rate_b * g.sum()
    return w, b


def train(docs: DataFrame, labels: DataFrame, logp: np.ndarray, label: str = "toxic", held_out: int = 0, modulus: int = 5, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """``(features, weights, bias)`` from at most ``rows`` labelled rows that aren't held out.

    The rows with the smallest md5 of their id; of several labels of a document the largest holds.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(logp)
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held_out)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    )

    def features(t: pa.Table) -> pa.Table:
        f = Features(sent.value)
        return pa.table({"doc_id": t.column("doc_id"), "y": t.column("__y"), "f": pa.array([f.of_text(s) for s in t.column("text").to_pylist()], pa.list_(pa.int32()))})

    sample = materialize(map_arrow(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), features, "doc_id bigint, y int, f array<int>"), "sample")
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not bad or bad == n:
        return np.empty(0, np.int64), np.empty(0), 10.0 if n and bad == n else -10.0
    seen = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    odds = F.log((F.col("k") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("k") + 0.5) / (n - bad + 1.0))
    # How far the counts are from those of a feature that says nothing, in widths of chance.
    share = bad / n
    gain = F.abs(F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    kept = seen.filter(F.col("n") >= 3).withColumn("gain", gain).filter((F.col("gain") > 3.5) & (F.abs(odds) > 1)).orderBy(F.col("gain").desc(), "f").limit(FEATURES_KEPT)
    ids = np.sort(kept.select("f").toArrow().column("f").to_numpy().astype(np.int64))
    wanted = spark.createDataFrame([(int(i),) for i in ids], "f int")
    hits = (
        sample.select("doc_id", "y", F.explode_outer("f").alias("f")).join(F.broadcast(wanted.withColumn("there", F.lit(True))), "f", "left")
        .groupBy("doc_id", "y").agg(F.collect_set(F.when(F.col("there"), F.col("f"))).alias("f")).orderBy("doc_id")
    ).toArrow()
    rows_ = [np.searchsorted(ids, np.array(r, np.int64)) for r in hits.column("f").to_pylist()]
    w, b = fit_linear(rows_, hits.column("y").to_numpy().astype(float), len(ids))
    return ids, w, b


def score(docs: DataFrame, logp: np.ndarray, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability that a whole text is toxic.

    Null and empty texts have no features, equal texts the same score; other columns stay, but for one named ``out``.
    """
    sent = docs.sparkSession.sparkContext.broadcast((logp, {int(i): float(w) for i, w in zip(model[0], model[1], strict=True)}, model[2]))

    @F.arrow_udf("double")
    def probability(data: pa.Array) -> pa.Array:
        logp, weights, bias = sent.value
        f = Features(logp, weights)
        z = [bias + sum(weights[i] for i in f.of_text(s)) for s in data.to_pylist()]
        return pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], pa.float64())

    return docs.withColumn(out, probability(F.col(text)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    logp = character_model(docs)
    model = train(docs, table(spark, sf_dir, "labels"), logp)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return score(docs, logp, model).select(
        "doc_id", (remainder == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op7_toxicity": op7_toxicity}

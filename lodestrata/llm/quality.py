"""Quality classifier: Bradley-Terry ranking from preference pairs.

A document's worth is a linear function of features of its whole text.  For a
pair in which one document is preferred, the log odds of the preference are
the difference of their worths, so the weights are learnt by logistic loss on
feature differences.  All pairs of a good and a bad labelled document count:
their sums need only the sums of each class over narrow ranges of worths.  The
threshold is a quantile of the training documents' worths: the share of those
marked bad.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import quantiles
from .common import discard, give_back, map_arrow, materialize, table

#: Width of a range of worths, in which rows count at their mean worth, and number of ranges that widens it.
RANGE, RANGES = 1 / 16, 2048
FEATURES = (
    "log_words", "mean_word", "upper", "digit", "space", "symbol", "pipe", "bang", "punctuation", "non_ascii",
    "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "symbol_words", "short_words", "upper_words",
    "byte_entropy", "single_letters", "adjacent_repeats",
)
_CLASS = np.zeros(256, dtype=np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\x0b\x0c", 3), (b"#$%&*@^~_=+<>/\\{}[]`", 4), (b"|", 5), (b"!?", 6), (b".,;:'\"()-", 7)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8


def features(data: bytes | None) -> list[float]:
    """Features of one whole text; all are bounded but ``log_words``.  Null and empty: zeros."""
    words = data.split() if data else []
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=hist, minlength=9) / size
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = hist[hist > 0] / size
    tails = [w[-1] for w in words]
    letters = sum(1 for c in tails if _CLASS[c] in (4, 5, 6)) if n < 64 else int(np.isin(_CLASS[tails], (4, 5, 6)).sum())
    return [
        math.log1p(n), size / n / (20 + size / n), by[1], by[2], by[3], by[4], by[5], by[6], by[7], by[8],
        len(counts) / n ** 0.8 if n > 1 else 1.0, max(counts.values()) / n, len(set(zip(words, words[1:]))) / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)), letters / n, sum(1 for w in words if len(w) < 3) / n,
        sum(1 for w in words if w.isupper() and len(w) > 1) / n, float(-(p * np.log2(p)).sum()) / 8,
        sum(1 for w in words if len(w) == 1) / n, sum(1 for a, b in zip(words, words[1:]) if a == b) / max(1, n - 1),
    ]


class Model:
    """Weights, scale of the features, and the calibrated threshold."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, w: np.ndarray, threshold: float, width: float):
        self.mean, self.sd, self.w, self.threshold, self.width = mean, sd, w, threshold, width

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.worth(x) - self.threshold) / self.width, -30, 30)
        return 1 / (1 + np.exp(-z))


#: From features and labels of some rows the sums of some values by key.
Sums = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _by_key(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, values
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(values[order], starts)


def _newton(keys: np.ndarray, sums: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Step of the loss over all pairs, from each range's rows (odd keys: good ones), sums of features and of their products."""
    d = len(w)
    products = np.zeros((len(keys), d, d))
    i, j = np.triu_indices(d)
    products[:, i, j] = products[:, j, i] = sums[:, 1 + d :]
    (ng, xg, pg), (nb, xb, pb) = ((sums[k, 0], sums[k, 1 : 1 + d], products[k]) for k in (keys % 2 == 1, keys % 2 == 0))
    miss = 1 / (1 + np.exp(np.clip(((xg @ w) / ng)[:, None] - (xb @ w) / nb, -30, 30)))
    weight, pairs = miss * (1 - miss), ng.sum() * nb.sum()
    # How features go with worths within a range.
    (sg, sb) = (p @ w - x * ((x @ w) / n)[:, None] for n, x, p in ((ng, xg, pg), (nb, xb, pb)))
    gradient = ((miss @ nb) @ xg - (weight @ nb) @ sg - (ng @ miss) @ xb - (ng @ weight) @ sb) / pairs - ridge * w
    cross = xg.T @ weight @ xb
    hessian = (np.tensordot(weight @ nb, pg, 1) + np.tensordot(ng @ weight, pb, 1) - cross - cross.T) / pairs + ridge * np.eye(d)
    return np.linalg.solve(hessian, gradient)


def _fit(total: Callable[[Sums], tuple[np.ndarray, np.ndarray]], quantile: Callable[[Callable[[np.ndarray], np.ndarray], float], float], ridge: float, steps: int) -> Model:
    """Bradley-Terry by Newton steps; ``total`` sums over all rows, ``quantile`` gives one of a value of all rows.

    With one class or none, worths are all 0 and every document passes (or
    none, if all are bad).
    """
    d = len(FEATURES)
    keys, sums = total(lambda x, y: _by_key(y, np.hstack([np.ones((len(x), 1)), x])))
    n = {int(k): float(v[0]) for k, v in zip(keys, sums, strict=True)}
    rows = sum(n.values())
    mean = sums[:, 1:].sum(axis=0) / rows if rows else np.zeros(d)
    sd = np.ones(d)
    if rows:
        squares = total(lambda x, y: _by_key(y, (x - mean) ** 2))[1].sum(axis=0)
        sd = np.where((s := np.sqrt(squares / rows)) > 1e-9, s, 1.0)
    if len(n) < 2:
        return Model(mean, sd, np.zeros(d), 1.0 if 0 in n else -1.0, 1.0)
    i, j = np.triu_indices(d)
    w = np.zeros(d)
    for _ in range(steps):
        # Worths lie within 8 times the sum of the weights.
        width = max(RANGE, 16 * float(np.abs(w).sum()) / RANGES)

        def ranged(x: np.ndarray, y: np.ndarray, w: np.ndarray = w, width: float = width) -> tuple[np.ndarray, np.ndarray]:
            z = np.clip((x - mean) / sd, -8, 8)
            return _by_key(2 * np.floor(z @ w / width).astype(np.int64) + y, np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]]))

        step = _newton(*total(ranged), w, ridge)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model = Model(mean, sd, w, 0.0, 1.0)
    # The quantile at the share of bad documents, taken halfway between its neighbours in rank.
    threshold = quantile(model.worth, (n[0] - 0.5) / (rows - 1))
    spread = quantile(lambda x: np.abs(model.worth(x) - threshold), 0.5)
    return Model(mean, sd, w, threshold, max(1e-6, spread / 3))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> Model:
    """The model of rows that are at hand, over all their pairs; ``train`` gives the same for a table."""
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, np.int64)
    return _fit(lambda part: part(x, y), lambda value, share: float(np.quantile(value(x), share)), ridge, steps)


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, x``: the features of each whole text."""

    def rows_of(t: pa.Table) -> pa.Table:
        return pa.table({"doc_id": t.column("doc_id"), "x": pa.array([features(b) for b in t.column("__bytes").to_pylist()], pa.list_(pa.float64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col(text).cast("binary").alias("__bytes")), rows_of, f"doc_id {kind}, x array<double>")


def _total(rows: DataFrame, part: Sums) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key over ``y, x`` of all rows: of each task's rows, then of the tasks', in an order of their own, so that reruns agree."""

    def added(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for keys, sums in batches:
            for k, v in zip(keys.tolist(), sums, strict=True):
                found[k] = found[k] + v if k in found else v.copy()
        if found:
            columns = {"k": pa.array(list(found), pa.int64()), "m": pa.array(list(found.values()), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns)
        give_back()

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096))
        yield from added(part(_matrix(b.column("x")), b.column("y").to_numpy().astype(np.int64)) for b in slices)

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added((b.column("k").to_numpy(), _rows(b.column("m"))) for b in batches if b.num_rows)

    schema = "k bigint, m array<double>"
    once = rows.select("y", "x").mapInArrow(of_rows, schema).withColumn("task", F.spark_partition_id())
    got = once.repartition(4, "k").sortWithinPartitions("k", "task").select("k", "m").mapInArrow(of_tasks, schema).toArrow().sort_by("k")
    return got.column("k").to_numpy(), _rows(got.column("m").combine_chunks()) if got.num_rows else np.zeros((0, 1 + len(FEATURES)))


def _rows(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: int, modulus: int, ridge: float = 1e-3, steps: int = 40) -> Model:
    """Fits on all labelled rows whose crc32(doc_id) mod ``modulus`` isn't ``held_out``, of ``docs`` with a ``text``, or with features ``x``.

    Null labels count for nothing; of several labels of a document the
    smallest holds.
    """
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held_out)
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    )
    given = "text" not in docs.columns
    found = docs.select("doc_id", "x") if given else materialize(featured(docs), "features")
    rows = materialize(found.join(chosen, "doc_id").select("y", "x"), "labelled")
    if not given:
        discard(found)

    def quantile(value: Callable[[np.ndarray], np.ndarray], share: float) -> float:
        at = F.arrow_udf(lambda x: pa.array(value(_matrix(x)), pa.float64()), "double")
        return quantiles(rows, at("x"), [share])[0]

    model = _fit(lambda part: _total(rows, part), quantile, ridge, steps)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each whole text, or of the features ``x`` that ``featured`` gave; it is at least 0.5 for those that pass.

    Null and empty texts have the score of no features, equal texts the same; other columns stay, but for one named ``out``.
    """

    @F.arrow_udf("double")
    def worth(data: pa.Array) -> pa.Array:
        x = np.array([features(b) for b in data.to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    if text not in docs.columns:
        return docs.withColumn(out, F.arrow_udf(lambda x: pa.array(model.score(_matrix(x)), pa.float64()), "double")("x"))
    return docs.withColumn(out, worth(F.col(text).cast("binary")))


def remainder(doc_id: str, modulus: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``; null and empty texts get the score of no features."""
    docs = materialize(featured(table(spark, sf_dir, "documents")), "features")
    model = train(docs, table(spark, sf_dir, "labels"), "quality", held_out=1, modulus=3)
    return score(docs, model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op9_quality": op9_quality}

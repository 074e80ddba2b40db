"""Nearest neighbours by randomly rotated one-bit codes.

A vector v lies near a centroid c; the direction of v - c is rotated by a random
orthogonal matrix and each coordinate keeps its sign only.  From the packed signs and
two scalars (the length of v - c, and the inner product of the direction with
its own code) the inner product with a query is estimated without bias, and
the error is bounded with high probability.  Vectors whose upper bound reaches
the k-th best exact score so far are scored again on the original vectors in
double precision; the others can't be among the nearest but by a failure of
the bound (``EPSILON`` standard widths).

The estimate works on the packed bits: a rotated query is cut into
``PLANES`` bit planes, and its inner product with a code is a weighted sum of the
counts of bits that code and plane have in common.  What rounding to planes
loses is added to the bound.

Centroids are fitted on a bounded sample; every row is indexed, and every row
is a candidate of every query.  Queries go to the executors in blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

K = 20
#: Centroids, and the bound of the rows that they are fitted on.
CENTROIDS, SAMPLE_ROWS = 16, 16_384
EPSILON = 2.5
QUERY_BLOCK = 16_384
#: Bits of a query's coordinates.
PLANES = 6
CHUNK_PAIRS = 1 << 20


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: pa.Array) -> list[np.ndarray | None]:
    """Vectors as doubles; None for null, empty, zero ones, and for those with a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for v in vectors.to_pylist():
        x = np.array(v, dtype=np.float64) if v and None not in v else None
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def centroids(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 8) -> np.ndarray:
    """Plain k-means from spread-out rows of the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    c = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, c)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = sample[near == j].mean(axis=0)
    return c


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as whole 64-bit words."""
    out = np.packbits(bits, axis=1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8))).view(np.uint64)


class Planes:
    """Rotated queries as bit planes: coordinate = low + step * (sum of 2^k times bit k), but for ``loss`` in the sum of all."""

    def __init__(self, turned: np.ndarray, planes: int = PLANES):
        top = (1 << planes) - 1
        self.low = turned.min(axis=1)
        spread = turned.max(axis=1) - self.low
        self.step = np.where(spread > 0, spread, 1.0) / top
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.loss = np.abs(self.low[:, None] + levels * self.step[:, None] - turned).sum(axis=1)
        self.total = turned.sum(axis=1)
        self.words = [packed((levels >> k) & 1) for k in range(planes)]

    def dot(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of codes (signs, +1 and -1) and queries, within ``loss`` * 2."""
        common = np.zeros((len(codes), len(self.low)), np.float32)
        for k, words in enumerate(self.words):
            count = np.zeros(common.shape, np.uint16)
            for w in range(codes.shape[1]):
                count += np.bitwise_count(codes[:, w, None] & words[None, :, w])
            common += count * np.float32(1 << k)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float32)
        return 2 * (common * self.step[None, :].astype(np.float32) + ones[:, None] * self.low[None, :].astype(np.float32)) - self.total[None, :].astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


class Model:
    """Centroids for each dimension that the sample has (the origin for others), and rotations."""

    def __init__(self, by_dim: dict[int, np.ndarray]):
        self.by_dim, self.turns = by_dim, {}

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in self.turns:
            self.turns[dim] = rotation(dim)
        return self.by_dim.get(dim, np.zeros((1, dim))), self.turns[dim]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Centroid, packed signs, length and factor of each row."""
        c, p = self.of(x.shape[1])
        near = nearest(x, c)
        rest = x - c[near]
        norm = np.linalg.norm(rest, axis=1)
        unit = rest / np.where(norm > 0, norm, 1)[:, None] @ p
        factor = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
        return near, packed(unit > 0), norm, np.where(norm > 0, factor, 1.0)


def fit(vectors: DataFrame, vec: str, key: str, rows: int = SAMPLE_ROWS) -> Model:
    sample = vectors.filter(F.col(key).isNotNull() & F.col(vec).isNotNull()).orderBy(F.xxhash64(key), key).limit(rows).select(vec).toArrow()
    found = [x for x in usable(sample.column(0)) if x is not None]
    dims = {len(x) for x in found}
    return Model({d: centroids(np.stack([x for x in found if len(x) == d])) for d in sorted(dims)})


def _narrow(x: np.ndarray) -> np.ndarray:
    """In single precision where that loses nothing, as for vectors that came in it."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if (y.astype(np.float64) == x).all() else x


def _wide(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in blobs])


def build_index(vectors: DataFrame, model: Model, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, dim, vector, centroid, code, norm, factor`` of every usable row; written to the shared folder."""
    sent = vectors.sparkSession.sparkContext.broadcast(model.by_dim)

    def index(t: pa.Table) -> pa.Table | None:
        model = Model(sent.value)
        ids, vs = t.column("vec_id").to_pylist(), usable(t.column("vector"))
        parts = []
        for d in sorted({len(v) for v in vs if v is not None}):
            own = [i for i, v in enumerate(vs) if v is not None and len(v) == d]
            x = np.stack([vs[i] for i in own])
            near, code, norm, factor = model.encode(x)
            parts.append(pa.table({
                "vec_id": pa.array([ids[i] for i in own], pa.int64()),
                "dim": pa.array(np.full(len(x), d, np.int32)),
                "vector": pa.array([v.tobytes() for v in _narrow(x)], pa.binary()),
                "centroid": pa.array(near, pa.int32()),
                "code": pa.array([r.tobytes() for r in code], pa.binary()),
                "norm": pa.array(norm), "factor": pa.array(factor),
            }))
        return pa.concat_tables(parts) if parts else None

    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("vec_id"), F.col(vec).alias("vector"))
    return materialize(map_arrow(rows, index, "vec_id bigint, dim int, vector binary, centroid int, code binary, norm double, factor double", 8192), "codes")


class _Best:
    """The k best exact scores of each query so far, best first; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        own = np.searchsorted(touched, q)
        all_q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), own])
        all_s = np.concatenate([self.score[touched].ravel(), score])
        all_i = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((all_i, -all_s, all_q))
        first = np.searchsorted(all_q[order], np.arange(len(touched)))
        take = order[first[:, None] + np.arange(self.k)[None, :]]
        self.score[touched], self.id[touched] = all_s[take], all_i[take]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, q)


def search_block(index: DataFrame, queries: list[tuple[int, np.ndarray]], model: Model, k: int = K, epsilon: float = EPSILON) -> DataFrame:
    """The best k of each part of the index for each query of one block: ``query_id, vec_id, score``."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in sorted({len(v) for _, v in queries}):
        own = [(i, v) for i, v in queries if len(v) == d]
        by_dim[d] = (np.array([i for i, _ in own], np.int64), np.stack([v for _, v in own]))
    sent = index.sparkSession.sparkContext.broadcast((model.by_dim, by_dim))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, by_dim = Model(sent.value[0]), sent.value[1]
        best: dict[int, _Best] = {d: _Best(len(ids), k) for d, (ids, _) in by_dim.items()}
        ready = {d: (Planes(q @ model.of(d)[1]), q @ model.of(d)[0].T, np.linalg.norm(q, axis=1)) for d, (_, q) in by_dim.items()}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            lengths = t.column("dim").to_numpy()
            for d in set(lengths.tolist()) & set(by_dim):
                part = t.filter(pa.array(lengths == d))
                ids_q, q = by_dim[d]
                planes, at_centroid, q_norm = ready[d]
                x = _wide(part.column("vector").to_pylist(), d)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(len(x), -1)
                ids, near = part.column("vec_id").to_numpy(), part.column("centroid").to_numpy()
                norm, factor = part.column("norm").to_numpy(), part.column("factor").to_numpy()
                gain = norm / factor / np.sqrt(d)
                width = norm * np.sqrt(np.maximum(0, 1 - factor**2)) / factor * epsilon / np.sqrt(max(1, d - 1))
                rows = max(1, CHUNK_PAIRS // max(1, len(q)))
                for at in range(0, len(x), rows):
                    s = slice(at, at + rows)
                    guess = planes.dot(codes[s]) * gain[s, None].astype(np.float32) + at_centroid[:, near[s]].T.astype(np.float32)
                    low = best[d].score[:, -1]
                    if np.isneginf(low).any():  # to start with, score the likeliest exactly
                        n = min(k + 1, len(guess))
                        i = np.argpartition(-guess, n - 1, axis=0)[:n].ravel()
                        j = np.tile(np.arange(len(q)), n)
                        ok = ids[s][i] != ids_q[j]
                        i, j = i[ok], j[ok]
                        seed = _Best(len(q), k)
                        seed.add(j, ids[s][i], _exact(x[s][i], q[j]))
                        low = np.maximum(low, seed.score[:, -1])
                    # Exact ties with the k-th best count, so a hair is added to what single precision gives.
                    top = guess + (2 * gain[s, None] * planes.loss[None, :]).astype(np.float32) + width[s, None].astype(np.float32) * q_norm[None, :].astype(np.float32) * np.float32(1.001) + np.float32(1e-5) * q_norm[None, :].astype(np.float32)
                    i, j = np.nonzero(top >= low[None, :])
                    ok = ids[s][i] != ids_q[j]
                    i, j = i[ok], j[ok]
                    for a in range(0, len(i), 1 << 18):
                        ii, jj = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
                        score = _exact(x[s][ii], q[jj])
                        good = score >= low[jj]
                        best[d].add(jj[good], ids[s][ii][good], score[good])
        for d, (ids_q, _) in by_dim.items():
            there = np.isfinite(best[d].score)
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(ids_q, there.sum(axis=1)), "vec_id": best[d].id[there], "score": best[d].score[there],
            })

    return index.select("vec_id", "dim", "vector", "centroid", "code", "norm", "factor").mapInArrow(scan, "query_id bigint, vec_id bigint, score double")


def one_per_id(vectors: DataFrame, vec: str, key: str) -> DataFrame:
    """Of rows that share an id the one with the greatest vector; null ids go."""
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), vec)
    repeated = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "repeated")
    if repeated.isEmpty():
        return rows
    single = rows.join(repeated, key, "left_anti")
    return single.unionByName(rows.join(repeated, key, "left_semi").groupBy(key).agg(F.max(vec).alias(vec)))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k nearest rows found, by inner product.

    Rows with the query's own id are no candidates of it.  Vectors are compared
    with those of their own length.  Unusable vectors and null ids take no
    part; of rows that share an id the one with the greatest vector does.  A query with fewer candidates gets all.  Equal vectors tie, and ties go to the
    smaller id.  An empty table gives none.
    """
    vectors, queries = one_per_id(vectors, vec, key), one_per_id(queries, vec, key)
    model = fit(vectors, vec, key)
    index = build_index(vectors, model, vec, key)
    asked = queries.toLocalIterator(prefetchPartitions=True)
    parts: list[DataFrame] = []
    block: dict[int, np.ndarray] = {}

    def flush() -> None:
        parts.append(materialize(search_block(index, sorted(block.items(), key=lambda x: x[0]), model, k), "found"))
        block.clear()

    for r in asked:
        x = usable(pa.array([r[1]]))[0]
        if x is not None:
            block[r[0]] = x
            if len(block) >= QUERY_BLOCK:
                flush()
    if block or not parts:
        flush()
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op8_nearest": op8_nearest}

"""A corpus pipeline: five stages, each written as Parquet and read again.

Quality filter, one document of each near-duplicate group, benchmark
decontamination, mixing to target weights, sharding.  Counts as part of
``lodestrata.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, mixing, ngram_join, quality, sharding
from lodestrata.llm.common import materialize, release, row_digest, table

#: Share of a document's words that benchmark passages may cover before it goes.
MAX_HIT_SHARE = 0.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (score under 0.5); repeated rows share their score, null texts that of no features."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", held_out=1, modulus=3)
    release(spark)
    return quality.score(docs, model, out="__score").filter(F.col("__score") >= 0.5).select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose digest, ``__row``, is in ``gone``."""
    return docs.withColumn("__row", row_digest("doc_id", "text")).join(gone, "__row", "left_anti")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id (null first).

    Rows are told apart by id and text, so several texts under one id are
    documents of their own.  Of rows with the same id and text one stays.
    Documents without words, null texts too, are in no group and stay.
    """
    keyed = docs.select(F.struct("doc_id", row_digest("doc_id", "text").alias("row")).alias("__key"), "text")
    found = ngram_join.near_duplicates(keyed, key="__key")
    gone = materialize(found.filter(F.col("__key") != F.col("component_id")).select(F.col("__key.row").alias("__row")), "gone")
    # Both go by the digest, so texts are shuffled once.
    return _without(docs, gone).dropDuplicates(["__row"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an occurrence of a benchmark window was found; null and empty texts stay, equal rows stay or go together."""
    keyed = docs.select(row_digest("doc_id", "text").alias("__row"), "text")
    found = decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"), key="__row")
    gone = materialize(found.filter(F.col("n_hit") > F.col("n_words") * MAX_HIT_SHARE).select("__row"), "hit")
    release(spark)
    return _without(docs, gone).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; counts are made without texts, which are shuffled once, to meet them.

    A null source is a source; texts without words are drawn at their source's rate.
    """
    mixed = mixing.mix(mixing.sized(docs.withColumn("__row", row_digest("doc_id", "text"))))
    release(spark)
    return mixing.emit(docs, mixed)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``size, tokens, shard, slot``; copies of a text lie in one shard, unless they outweigh one.

    Null texts count as empty ones; no row is dropped, and slots are gapless.
    """
    return sharding.assign(sharding.fingerprints(docs)).select(*docs.columns, "size", "tokens", "shard", "slot")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier's fit can't be written as SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Running sums over a whole table in two levels: within ranges of its order, and over the ranges' totals.

No task sees all rows.  The ranges are written to the shared folder once, so both
levels see the same ones, and a lost executor costs a reread.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import Rejected

LOCAL_DIR = "file:///tmp/checkpoints"
#: Rows of one block of a table in its order, where columns look back over rows.
BLOCK_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; only where all of Spark runs on this machine may the session leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(p)
    system.deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A written copy, so that a loop's plan doesn't grow and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``__range``: rows of a lower range come first in ``order``, equal ones share a range; written."""
    return cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each of ``sums`` the sum over the rows up to this one in ``order``, which must tell all rows apart.

    What is summed over the ranges has a row for each of Spark's shuffle partitions at most.
    """
    cut_up = in_ranges(df, order)
    total = cut_up.groupBy(F.col("__range").alias("__r")).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select("__r", *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut_up.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    return out.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(f"__{n}", F.lit(0)) for n, c in sums.items()}).drop("__range", "__r", *[f"__{n}" for n in sums])


def with_next(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Adds the value of ``order`` in the following row; ``df`` has each value once."""
    cut_up = in_ranges(df.withColumn("__v", order), [F.col("__v")])
    firsts = cut_up.groupBy(F.col("__range").alias("__r")).agg(F.min("__v").alias("__first"))
    firsts = firsts.select("__r", F.lead("__first").over(Window.orderBy("__r")).alias("__first"))
    within = Window.partitionBy("__range").orderBy("__v")
    out = cut_up.join(F.broadcast(firsts), F.col("__range") == F.col("__r"))
    return out.withColumn(name, F.coalesce(F.lead("__v").over(within), F.col("__first"))).drop("__v", "__range", "__r", "__first")


def looking_back(df: DataFrame, order: Sequence[str], groups: Sequence[str], back: int, add: Callable[[WindowSpec], dict[str, Column]], rows: int | None = None) -> DataFrame:
    """Adds columns over a window of each group in ``order`` that look back over at most ``back`` rows.

    Rows are numbered along groups and order and cut into blocks of ``rows`` (``BLOCK_ROWS``); the last ``back`` rows of a block are also given to
    the next, so a group may be as large as the table.
    """
    rows = rows or BLOCK_ROWS
    if not 0 <= back <= rows:
        raise Rejected(f"looking back over {back} rows, of {rows} at most")
    at = running(df, [F.col(c) for c in (*groups, *order)], {"__at": F.lit(1)}).withColumn("__at", F.col("__at") - 1)
    own = F.expr(f"__at div {rows}")
    late = F.pmod(F.col("__at"), F.lit(rows)) >= rows - back
    dealt = at.withColumn("__block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__block", *groups).orderBy("__at")
    return dealt.withColumns(add(w)).filter(F.col("__block") == own).drop("__at", "__block")


def quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, halfway between neighbours by their distance; nulls are left out, and nothing but the values at those places comes to the driver.

    Values are counted, and the counts summed along their order in ranges, so no task holds all of them.
    """
    counts = df.select(value.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = cut(running(counts, [F.col("v")], {"upto": F.col("n")}))
    n = upto.agg(F.max("upto")).first()[0]
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    wanted = sorted({int(h) for h in places} | {min(n - 1, int(h) + 1) for h in places})
    ranks = F.array(*[F.lit(k).cast("bigint") for k in wanted])
    hit = upto.select("v", F.explode(F.filter(ranks, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))).alias("k"))
    at = {r.k: r.v for r in hit.collect()}
    return [at[int(h)] if h == int(h) else (int(h) + 1 - h) * at[int(h)] + (h - int(h)) * at[int(h) + 1] for h in places]

"""Event-time streams: tumbling windows with visible late rows, and batch twins with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_watermark_twin(df: DataFrame, time: str, arrival: str, lateness: str) -> DataFrame:
    """Adds ``watermark`` (of the rows before, in the order of ``arrival``) and ``late``: the exact rule, row by row.

    The running maximum is global by definition.  It comes in two steps: within each
    of many ranges of the arrival order, and over the ranges' maxima; no task sees all rows.
    """
    t = F.col(time).cast("timestamp")
    parts = 256
    low, high = df.agg(F.min(arrival).cast("double"), F.max(arrival).cast("double")).first()
    width = ((high or 0) - (low or 0)) / parts or 1.0
    cut = df.withColumn("__part", F.least(F.lit(parts - 1), F.floor((F.col(arrival).cast("double") - F.lit(low or 0.0)) / width)).cast("int"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(F.col("__part").alias("__p")).agg(F.max(t).alias("__top")).select("__p", F.max("__top").over(before).alias("__earlier"))
    within = Window.partitionBy("__part").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest(F.max(t).over(within), F.col("__earlier"))
    out = cut.join(F.broadcast(tops), F.col("__part") == F.col("__p")).withColumn("watermark", top - F.expr(f"interval {lateness}"))
    return out.withColumn("late", F.coalesce(t < F.col("watermark"), F.lit(False))).drop("__part", "__p", "__earlier")


def tumbling_twin(df: DataFrame, time: str, arrival: str, window: str, lateness: str) -> DataFrame:
    """``window_start, window_end, n, closed``: rows that came too late are left out of windows but still move the watermark."""
    marked = with_watermark_twin(df, time, arrival, lateness)
    t = F.col(time).cast("timestamp")
    end = df.agg((F.max(t) - F.expr(f"interval {lateness}")).alias("__final"))
    w = F.window(t, window)
    rows = marked.filter("not late").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(end)).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", (F.col("w.end") <= F.col("__final")).alias("closed"))


def tumbling(stream: DataFrame, time: str, window: str, lateness: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of event-time windows of a stream; in append mode a window comes once it is closed."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sliding(stream: DataFrame, time: str, window: str, slide: str, lateness: str) -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sessions(stream: DataFrame, time: str, gap: str, lateness: str, key: str) -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def feedback(predictions: DataFrame, labels: DataFrame, key: str, time: str, due: str, lateness: str, within: str) -> DataFrame:
    """Stream-stream join: a label meets its prediction if it is due within the interval after it."""
    p = predictions.withWatermark(time, lateness).alias("p")
    right = labels.withWatermark(due, lateness).alias("l")
    cond = F.expr(f"p.{key} = l.{key} AND l.{due} >= p.{time} AND l.{due} <= p.{time} + INTERVAL {within}")
    return p.join(right, cond).select(F.col(f"p.{key}").alias(key), *[F.col(f"p.{c}").alias(c) for c in predictions.columns if c != key], *[F.col(f"l.{c}").alias(c) for c in labels.columns if c != key])


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what is there, writes Parquet, and stops; started again with the same checkpoint it goes on."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def split_late(batch: DataFrame, time: str, watermark: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch, for ``foreachBatch``: late rows go to a side table and aren't lost."""
    late = F.col(time) < F.lit(watermark).cast("timestamp")
    return batch.filter(~late), batch.filter(late)


def cursor_check(df: DataFrame, source: str, offset: str) -> DataFrame:
    """``source, first, last, rows, missing, repeated`` of each source's offsets: a resumed read must leave no gap and bring nothing twice."""
    counts = df.groupBy(F.col(source).alias("source"), F.col(offset).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("source").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    return out.select("source", "first", "last", "rows", (F.col("last") - F.col("first") + 1 - F.col("k")).alias("missing"), (F.col("rows") - F.col("k")).alias("repeated"))

"""The data of charts: each is an aggregate; drawing is left to others."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_cdf, normal_quantile, t_quantile
from ..functions.values import Rejected, dtype, finite, is_numeric
from .running import cut, running


def _finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(finite(F.col(c), dtype(df, c)))
    return df


def _range(df: DataFrame, column: str) -> tuple[float, float]:
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        raise Rejected("no finite values")
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def _bin(column: str, low: float, high: float, bins: int):
    return F.least(F.lit(bins - 1), F.floor((F.col(column).cast("double") - low) / ((high - low) / bins))).cast("int")


def histogram(df: DataFrame, column: str, bins: int, weight: str | None = None, groups: Sequence[str] = (), normalise: str = "count") -> DataFrame:
    """``bin, low, high, n``: bins are closed on the left, the last on both sides; empty ones are there when there are no groups."""
    data = _finite(df, column, *([weight] if weight else []))
    low, high = _range(data, column)
    width = (high - low) / bins
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    found = data.groupBy(*groups, _bin(column, low, high, bins).alias("bin")).agg(amount.alias("n"))
    if not groups:
        found = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(found), "bin", "left").fillna(0, ["n"])
    if normalise != "count":
        total = F.sum("n").over(Window.partitionBy(*groups))
        found = found.withColumn("n", F.col("n") / total * (100 if normalise == "percent" else 1 / width))
    edge = lambda i: low + i * width
    return found.select(*groups, "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")


def box(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Quartiles, and whiskers at the extreme values seen within 1.5 ranges of them."""
    data = _finite(df, column)
    q = data.groupBy(*groups).agg(F.percentile(F.col(column).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__{g}"))
    c, spread = F.col(column).cast("double"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (c >= F.col("q1") - spread) & (c <= F.col("q3") + spread)
    joined = data.join(F.broadcast(q) if not groups else q, cond)
    return joined.groupBy(*groups, "q1", "median", "q3").agg(
        F.min(F.when(inside, c)).alias("whisker_low"), F.max(F.when(inside, c)).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("fliers"), F.count(F.lit(1)).alias("n")
    )


def bar(df: DataFrame, category: str, op: str = "count", column: str | None = None) -> DataFrame:
    """``category, value`` with count, sum, mean, median, min or max of finite values."""
    ops = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
    data = _finite(df, column) if column and is_numeric(dtype(df, column)) else df
    return data.groupBy(F.col(category).alias("category")).agg(ops[op](column).alias("value"))


def line(df: DataFrame, x: str, y: str, op: str = "mean", group: str | None = None) -> DataFrame:
    if op == "reject":
        if df.groupBy(x, *([group] if group else [])).count().filter("count > 1").limit(1).count():
            raise Rejected("an x has two values")
        op = "max"
    keys = [F.col(x).alias("x"), *([F.col(group).alias("series")] if group else [])]
    return _finite(df, y).groupBy(*keys).agg({"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[op](y).alias("y"))


def grid(df: DataFrame, x: str, y: str, bins: int, density: bool = False) -> DataFrame:
    """``ix, iy, n`` of the cells that have points; with ``density``, n over rows and cell area."""
    data = _finite(df, x, y)
    (x0, x1), (y0, y1) = _range(data, x), _range(data, y)
    cells = data.groupBy(_bin(x, x0, x1, bins).alias("ix"), _bin(y, y0, y1, bins).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    if density:
        area = (x1 - x0) / bins * (y1 - y0) / bins
        cells = cells.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy()) * area))
    return cells


def hexbin(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """``cx, cy, n``: of two staggered lattices the nearer centre in the metric x² + 3y²."""
    data = _finite(df, x, y)
    (x0, x1), (y0, y1) = _range(data, x), _range(data, y)
    ny = max(1, int(bins / math.sqrt(3)))
    u, v = (F.col(x).cast("double") - x0) / (x1 - x0) * bins, (F.col(y).cast("double") - y0) / (y1 - y0) * ny
    a, b = (F.rint(u), F.rint(v)), (F.floor(u) + 0.5, F.floor(v) + 0.5)
    near = lambda c: (u - c[0]) * (u - c[0]) + 3 * (v - c[1]) * (v - c[1])
    first = near(a) < near(b)
    pick = lambda i: F.when(first, a[i]).otherwise(b[i])
    return data.groupBy((pick(0) * ((x1 - x0) / bins) + x0).alias("cx"), (pick(1) * ((y1 - y0) / ny) + y0).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def cell_heatmap(df: DataFrame, x: str, y: str, value: str, op: str = "mean") -> DataFrame:
    if op == "reject" and df.groupBy(x, y).count().filter("count > 1").limit(1).count():
        raise Rejected("two rows for one cell")
    return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg({"mean": F.avg, "sum": F.sum, "count": F.count, "reject": F.max}[op](value).alias("value"))


def missing_rates(df: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("missing"), F.count(F.lit(1)).alias("rows")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*", (F.col("p.missing") / F.col("p.rows")).alias("rate"))


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``pattern, rows``: one digit for each column, 1 where it's null."""
    return df.groupBy(F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns]).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def kde(df: DataFrame, column: str, rule: str = "scott", points: int = 128) -> DataFrame:
    """``x, density``: Gaussian kernel on a grid over the range and three widths beyond.

    Values are counted first and the grid is an array in the row, so there's one pass and no row for each pair.
    """
    data = _finite(df, column)
    n, sd, low, high = data.agg(F.count(F.lit(1)), F.stddev_samp(column).cast("double"), F.min(column).cast("double"), F.max(column).cast("double")).first()
    if not sd:
        raise Rejected("no spread")
    h = sd * n ** (-0.2) * ((4 / 3) ** 0.2 if rule == "silverman" else 1)
    start, step = low - 3 * h, (high - low + 6 * h) / (points - 1)
    v = F.col("v")
    counts = data.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    sums = [F.sum(F.col("w") * F.exp(-0.5 * F.pow((F.lit(start + i * step) - v) / h, F.lit(2.0)))) for i in range(points)]
    cells = [F.struct(F.lit(start + i * step).alias("x"), (s / (n * h * math.sqrt(2 * math.pi))).alias("density")) for i, s in enumerate(sums)]
    return counts.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def qq(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """``p, theoretical, value``: plotting position (i + 0.5) / n against the fitted normal."""
    data = _finite(df, column)
    n, mean, sd = data.agg(F.count(F.lit(1)), F.avg(column).cast("double"), F.stddev_samp(column).cast("double")).first()

    placed = running(data.select(F.col(column).alias("value"), F.col(ordinal).alias("ordinal")), [F.col("value"), F.col("ordinal")], {"k": F.lit(1)})
    p = (F.col("k") - 0.5) / n
    return placed.select(F.col("value").cast("double").alias("value"), p.alias("p"), (normal_quantile(p) * F.lit(float(sd or 0)) + F.lit(float(mean or 0))).alias("theoretical"))


def pp(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """``p, theoretical``: plotting position (i + 0.5) / n against the fitted normal's distribution function there."""
    data = _finite(df, column)
    n, mean, sd = data.agg(F.count(F.lit(1)), F.avg(column).cast("double"), F.stddev_samp(column).cast("double")).first()
    placed = running(data.select(F.col(column).cast("double").alias("value"), F.col(ordinal).alias("ordinal")), [F.col("value"), F.col("ordinal")], {"k": F.lit(1)})
    z = (F.col("value") - F.lit(float(mean or 0))) / F.lit(float(sd or 1))
    return placed.select(((F.col("k") - 0.5) / n).alias("p"), normal_cdf(z).alias("theoretical"))


def error_bars(df: DataFrame, category: str, value: str, kind: str = "sd", level: float = 0.95) -> DataFrame:
    """``category, n, mean, half``: sd, standard error, or half of a t interval; groups of two at least."""
    cells = _finite(df, value).groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).filter("n >= 2")
    half = {"sd": F.col("sd"), "se": F.col("sd") / F.sqrt("n")}.get(kind)
    if half is None:

        def quantiles(batches):
            for b in batches:
                sizes = b.column("n").to_pylist()
                yield pa.RecordBatch.from_pydict({"n": sizes, "t": pa.array([t_quantile((1 + level) / 2, s - 1) for s in sizes], pa.float64())})

        cells = cut(cells)
        table = cells.select("n").distinct().mapInArrow(quantiles, "n bigint, t double")
        cells, half = cells.join(table, "n"), F.col("t") * F.col("sd") / F.sqrt("n")
    return cells.select("category", "n", "mean", half.alias("half"))


def calendar(df: DataFrame, day: str, year: int, op: str = "count", value: str | None = None) -> DataFrame:
    """``day, week, weekday, value`` of one year; weeks begin on Monday."""
    d = F.to_date(day)
    out = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(value), "mean": lambda: F.avg(value)}[op]()
    start = F.date_trunc("week", F.make_date(F.lit(year), F.lit(1), F.lit(1))).cast("date")
    return df.filter(F.year(d) == year).groupBy(d.alias("day")).agg(out.alias("value")).select("day", F.floor(F.datediff("day", start) / 7).cast("int").alias("week"), (F.weekday("day") + 1).alias("weekday"), "value")


def radar(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """``entity, axis, value``: columns scaled to 0..1 over all rows, constant ones 0.5, then averaged."""
    ranges = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = [F.avg((F.col(c) - ranges[f"lo_{c}"]) / (ranges[f"hi_{c}"] - ranges[f"lo_{c}"]) if ranges[f"hi_{c}"] != ranges[f"lo_{c}"] else F.lit(0.5)).alias(c) for c in columns]
    return df.groupBy(F.col(entity).alias("entity")).agg(*scaled).unpivot(["entity"], list(columns), "axis", "value")


def tree(df: DataFrame, node: str, parent: str, amount: str) -> DataFrame:
    """``node, depth, total``: amounts of leaves summed up to the root; one root, no cycles, any depth."""
    nodes = df.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(amount).cast("double").alias("amount"))
    if nodes.filter("parent is null").count() != 1:
        raise Rejected("one root is needed")
    level, all_levels = nodes.filter("parent is null").select("node", F.array("node").alias("path")), None
    nodes = cut(nodes)
    while True:
        all_levels = level if all_levels is None else all_levels.unionByName(level)
        level = cut(nodes.join(level.select(F.col("node").alias("parent"), "path"), "parent").select("node", F.concat("path", F.array("node")).alias("path")))
        if level.isEmpty():
            break
    reached = all_levels.join(nodes.select("node", "amount"), "node")
    if reached.count() != nodes.count():
        raise Rejected("a cycle or a lost node")
    sums = reached.select(F.explode("path").alias("node"), "amount").groupBy("node").agg(F.sum("amount").alias("total"))
    return sums.join(reached.select("node", (F.size("path") - 1).alias("depth")), "node").select("node", "depth", "total")


def flow_levels(df: DataFrame, source: str, target: str, amount: str) -> DataFrame:
    """``node, level, inflow, outflow`` of a balanced flow without cycles; a level is the longest path to the node."""
    e = df.groupBy(F.col(source).alias("s"), F.col(target).alias("t")).agg(F.sum(amount).cast("double").alias("w"))
    if e.filter("w < 0 or s = t").limit(1).count():
        raise Rejected("negative or circular")
    flows = e.select(F.col("s").alias("node"), F.lit(0.0).alias("i"), F.col("w").alias("o")).unionByName(e.select(F.col("t").alias("node"), F.col("w").alias("i"), F.lit(0.0).alias("o")))
    sums = flows.groupBy("node").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"))
    if sums.filter("inflow > 0 and outflow > 0 and abs(inflow - outflow) > 1e-9 * greatest(inflow, outflow)").limit(1).count():
        raise Rejected("a node isn't balanced")
    # Level by level the nodes go that no node left leads to; a cycle is what never goes.
    left, edges, levels, k = cut(sums.select("node")), cut(e.select("s", "t").distinct()), None, 0
    while not left.isEmpty():
        free = cut(left.join(edges.select(F.col("t").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            raise Rejected("a cycle")
        own = free.withColumn("level", F.lit(k))
        levels, k = own if levels is None else levels.unionByName(own), k + 1
        left = cut(left.join(free, "node", "left_anti"))
        edges = cut(edges.join(free, F.col("s") == F.col("node"), "left_anti"))
    if levels is None:
        return sums.withColumn("level", F.lit(0)).select("node", "level", "inflow", "outflow")
    return levels.join(sums, "node").select("node", "level", "inflow", "outflow")


def choropleth(df: DataFrame, region: str, value: str, edges: Sequence[float]) -> DataFrame:
    """Class of each region: how many thresholds its value reaches."""
    k = F.lit(0)
    for e in edges:
        k = k + (F.col("value") >= e).cast("int")
    return _finite(df, value).groupBy(F.col(region).alias("region")).agg(F.sum(value).alias("value")).withColumn("class", k)

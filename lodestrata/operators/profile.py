"""Profiles of columns and tables, comparison of versions, KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import dtype, finite, is_float, is_numeric


def _value(df: DataFrame, column: str) -> Column:
    t = dtype(df, column)
    return F.when(finite(F.col(column), t), F.col(column)) if is_numeric(t) else F.col(column)


def profile(df: DataFrame, column: str) -> DataFrame:
    """One row about one column: counts of special values, distinct values, extremes, moments, quartiles."""
    t, c = dtype(df, column), F.col(column)
    n = lambda cond: F.count(F.when(cond, 1))
    special = {"rows": F.count(F.lit(1)), "nulls": n(c.isNull())}
    if is_float(t):
        special |= {"nans": n(F.isnan(c)), "plus_inf": n(c == float("inf")), "minus_inf": n(c == float("-inf"))}
    if isinstance(t, T.StringType):
        special |= {"empty": n(c == "")}
    v = _value(df, column)
    out = special | {"valid": F.count(v), "distinct": F.count_distinct(F.when(v == 0, F.lit(0).cast(t)).otherwise(v) if is_float(t) else v), "min": F.min(v), "max": F.max(v)}
    if is_numeric(t):
        d = v.cast("double")
        q = F.percentile(d, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
        out |= {"mean": F.avg(d), "std": F.stddev_samp(d)} | {f"q{int(p * 100):02d}": q[i] for i, p in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))}
    return df.agg(*[e.alias(k) for k, e in out.items()])


def inventory(df: DataFrame) -> DataFrame:
    """One row for each column: type and counts, from one aggregate over the table."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        nan = F.count(F.when(F.isnan(c), 1)) if is_float(f.dataType) else F.lit(0).cast("bigint")
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(c).alias("non_null"), F.count(F.when(c.isNull(), 1)).alias("nulls"), nan.alias("nans")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def summary(df: DataFrame, column: str) -> DataFrame:
    v = _value(df, column)
    base = [F.lit(column).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(column).isNull(), 1)).alias("missing"), F.count_distinct(v).alias("distinct")]
    q = F.percentile(v.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if is_numeric(dtype(df, column)) else F.lit(None).cast("array<double>")
    return df.agg(*base, q.alias("q")).select("column", "rows", "missing", "distinct", *[F.get("q", F.lit(i)).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


def compare(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summaries of the same columns in two versions, side by side."""
    out = None
    for c in columns:
        a, b = summary(before, c), summary(after, c)
        both = a.select("column", *[F.col(x).alias(f"{x}_before") for x in a.columns[1:]]).join(b.select("column", *[F.col(x).alias(f"{x}_after") for x in b.columns[1:]]), "column")
        out = both if out is None else out.unionByName(both)
    return out


def schema_changes(before: DataFrame, after: DataFrame) -> list[tuple[str, str]]:
    """(column, same, type_changed, removed or added)."""
    old, new = {f.name: f.dataType for f in before.schema}, {f.name: f.dataType for f in after.schema}
    return [(n, "removed" if n not in new else "same" if new[n] == t else "type_changed") for n, t in old.items()] + [(n, "added") for n in new if n not in old]


def kpi(df: DataFrame, op: str, column: str | None, denominator: str = "none", denominator_column: str | None = None) -> DataFrame:
    """``numerator, denominator, value``; no value where the denominator is 0 or unknown."""
    v = _value(df, column) if column else None
    top = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v)}[op]()
    below = {"none": lambda: F.lit(1), "rows": lambda: F.count(F.lit(1)), "non_null": lambda: F.count(column), "sum": lambda: F.sum(_value(df, denominator_column))}[denominator]()
    return df.agg(top.cast("double").alias("numerator"), below.cast("double").alias("denominator")).withColumn("value", F.try_divide("numerator", "denominator"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    ok = finite(F.col(value), dtype(df, value)) & finite(F.col(weight), dtype(df, weight))
    return df.filter(ok).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def survey_mean(df: DataFrame, value: str, weight: str, stratum: str, unit: str) -> DataFrame:
    """Weighted mean and its linearised variance, from totals of sampling units within strata (two units at least)."""
    w, v = F.col(weight), F.col(value)
    total, mean = df.agg(F.sum(w).alias("w"), (F.sum(w * v) / F.sum(w)).alias("m")).first()
    units = df.groupBy(stratum, unit).agg(F.sum(w * (v - mean) / total).alias("z"))
    strata = units.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), (F.var_samp("z") * F.count(F.lit(1))).alias("s"))
    return strata.filter("n >= 2").agg(F.lit(float(mean)).alias("mean"), F.sum("s").alias("variance"), F.sqrt(F.sum("s")).alias("se"))


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """``a, b, n, r`` of each pair: rows where both are finite; null for constant columns or fewer than two rows."""
    from .windows import average_rank

    out = []
    if method == "pearson":
        parts = []
        for i, a in enumerate(columns):
            for b in columns[i:]:
                ok = finite(F.col(a), dtype(df, a)) & finite(F.col(b), dtype(df, b))
                x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
                r = F.when((F.count(x) > 1) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.corr(x, y))
                parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), r.alias("r")))
        return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            ok = df.filter(finite(F.col(a), dtype(df, a)) & finite(F.col(b), dtype(df, b))).select(F.col(a).alias("x"), F.col(b).alias("y"))
            ranked = average_rank(average_rank(ok, "x", "rx"), "y", "ry")
            out.append(ranked.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("r")))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def chunk_summary(df: DataFrame, chunk: str, value: str) -> DataFrame:
    """``chunk, n, total, low, high`` of each chunk, and of all (null chunk) from the chunks' rows: the second phase reads no values again."""
    v = _value(df, value)
    parts = df.groupBy(F.col(chunk).alias("chunk")).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))
    return parts.groupingSets([["chunk"], []], "chunk").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def suitability(df: DataFrame, target: str) -> DataFrame:
    """``column, missing, constant, copies_target``: columns that a model can't learn from, or would cheat with; one pass."""
    y = F.col(target)
    cells = []
    for c in df.columns:
        if c != target:
            v = F.col(f"`{c}`")
            same = F.count(F.when(v.cast("string").eqNullSafe(y.cast("string")), 1)) == F.count(F.lit(1))
            cells.append(F.struct(F.lit(c).alias("column"), F.count(F.when(v.isNull(), 1)).alias("missing"), F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias("constant"), same.alias("copies_target")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")

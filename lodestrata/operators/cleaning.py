"""Cleaning: missing values, fills, categories, conversions, duplicates, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import Rejected, dtype, exact_cast, finite, is_float, literal, strip
from .running import quantiles


def missing(df: DataFrame, column: str, policy: str = "null") -> Column:
    """``null``: null alone; ``null_nan``: NaN too."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) if policy == "null_nan" and is_float(dtype(df, column)) else c.isNull()


def _any(parts: list[Column], every: bool) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p if every else out | p
    return out


def drop_missing_rows(df: DataFrame, columns: Sequence[str], how: str = "any", policy: str = "null") -> DataFrame:
    return df.filter(~_any([missing(df, c, policy) for c in columns], how == "all"))


def drop_missing_columns(df: DataFrame, columns: Sequence[str], how: str = "all", policy: str = "null") -> DataFrame:
    """Drops columns with any or only missing values: one aggregate; all columns can't go."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(missing(df, c, policy), 1)).alias(c) for c in columns]).first()
    gone = [c for c in columns if (counts[c] > 0 if how == "any" else counts["__n"] > 0 and counts[c] == counts["__n"])]
    if len(gone) == len(df.columns):
        raise Rejected("no column would stay")
    return df.drop(*gone)


def fill_constant(df: DataFrame, column: str, value: object, policy: str = "null") -> DataFrame:
    return df.withColumn(column, F.when(missing(df, column, policy), literal(value, dtype(df, column))).otherwise(F.col(column)))


def fill_statistic(df: DataFrame, column: str, statistic: str, policy: str = "null") -> DataFrame:
    """Mean or median of finite values; refused if the column's type can't hold it exactly."""
    t = dtype(df, column)
    kept = F.when(finite(F.col(column), t), F.col(column))
    if statistic == "median":
        value, rows = F.lit(quantiles(df, kept, [0.5])[0]).cast("double"), df.sparkSession.range(1)
    else:
        value, rows = {"mean": F.avg}[statistic](kept), df
    learned = rows.select(value.alias("v"), value.cast(t).alias("c"), (value.cast(t) == value).alias("same")).first()
    if learned.v is None:
        raise Rejected("nothing to learn from")
    if not learned.same:
        raise Rejected(f"{statistic} {learned.v} isn't a {t.simpleString()}")
    return df.withColumn(column, F.when(missing(df, column, policy), F.lit(learned.c).cast(t)).otherwise(F.col(column)))


def fill_mode(df: DataFrame, column: str, choose: object = None, policy: str = "null") -> DataFrame:
    """The most frequent value; of tied ones ``choose`` must be one, else a tie is refused."""
    counts = df.filter(~missing(df, column, policy)).groupBy(column).count()
    top = counts.join(counts.agg(F.max("count").alias("__m")), F.col("count") == F.col("__m")).select(column).limit(1001).collect()
    values = [r[0] for r in top]
    if not values or len(values) > 1 and choose not in values:
        raise Rejected(f"{len(values)} values are most frequent")
    value = choose if len(values) > 1 else values[0]
    return df.withColumn(column, F.when(missing(df, column, policy), F.lit(value).cast(dtype(df, column))).otherwise(F.col(column)))


def trim(df: DataFrame, column: str, side: str = "both") -> DataFrame:
    return df.withColumn(column, strip(F.col(column), side))


def map_categories(df: DataFrame, column: str, pairs: dict, unmapped: str = "keep") -> DataFrame:
    if len(pairs) > 1000:
        raise Rejected("at most 1000 pairs")
    c = F.col(column)
    if unmapped == "reject" and df.filter(c.isNotNull() & ~c.isin(list(pairs))).limit(1).count():
        raise Rejected("values without a mapping")
    return df.replace(pairs, subset=[column])


def convert(df: DataFrame, column: str, target: str, on_error: str = "reject", date_format: str | None = None, truth: tuple[str, str] = ("true", "false")) -> DataFrame:
    """Lossless conversion; what would lose something is refused, or null with ``on_error='null'``."""
    out = exact_cast(F.col(column), dtype(df, column), target, date_format, truth)
    if on_error == "reject":
        bad = df.filter(F.col(column).isNotNull() & out.isNull()).limit(1).count()
        if bad:
            raise Rejected(f"{column!r} has values that are no {target}")
    return df.withColumn(column, out)


def ordered_fill(df: DataFrame, column: str, groups: Sequence[str], order: Sequence[str], ordinal: str, direction: str = "forward") -> DataFrame:
    """The last known value of the group; leading gaps stay."""
    if not groups or column in (*groups, *order):
        raise Rejected("groups are needed, and the column can't be a key")
    keys = [F.col(c) for c in (*order, ordinal)]
    if direction == "backward":
        keys = [k.desc() for k in keys]
    w = Window.partitionBy(*groups).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], ordinal: str, keep: str = "first", descending: bool = False) -> DataFrame:
    """One row for each key.  ``descending`` turns the order columns only; ties stay in the order of ``ordinal``.

    An aggregate of the wanted row, not a window: rows combine before the
    shuffle, so a key that holds a third of all rows is no hot task.
    """
    rank = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order], F.col(ordinal))
    pick = F.max_by if keep == "last" else F.min_by
    if descending:
        # Ties must still fall to the earliest (or, for last, the latest) row: the order and the ordinal go apart.
        best = (F.min if keep == "last" else F.max)(F.struct(*[F.col(c) for c in order])).alias("__best")
        top = df.groupBy(*keys).agg(best)
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        tied = df.join(top.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__best"), cond & F.struct(*[F.col(c) for c in order]).eqNullSafe(F.col("__best")))
        return dedup(tied.select(*df.columns), keys, [], ordinal, keep)
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(pick(row, rank).alias("__row")).select("__row.*")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def iqr_bounds(df: DataFrame, column: str, multiplier: float = 1.5) -> tuple[float | None, float | None]:
    c = F.when(finite(F.col(column), dtype(df, column)), F.col(column))
    q = quantiles(df, c, [0.25, 0.75])
    if q[0] is None:
        return None, None
    return float(q[0]) - multiplier * (float(q[1]) - float(q[0])), float(q[1]) + multiplier * (float(q[1]) - float(q[0]))


def outliers_iqr(df: DataFrame, column: str, multiplier: float = 1.5, action: str = "mark", flag: str = "outlier") -> DataFrame:
    """Marks, or leaves out, finite values beyond the quartiles by more than ``multiplier`` ranges."""
    low, high = iqr_bounds(df, column, multiplier)
    c = F.col(column)
    out = F.lit(False) if low is None else finite(c, dtype(df, column)) & ((c < low) | (c > high))
    out = F.coalesce(out, F.lit(False))
    return df.withColumn(flag, out) if action == "mark" else df.filter(~out)


def outlier_candidates(df: DataFrame, column: str) -> DataFrame:
    """Rows that any of three methods marks: quartiles, robust z over 3.5, classic z over 3 (population)."""
    t = dtype(df, column)
    c = F.when(finite(F.col(column), t), F.col(column)).cast("double")
    low, high = iqr_bounds(df, column)
    if low is None:
        return df.limit(0).withColumns({m: F.lit(False) for m in ("by_iqr", "by_robust_z", "by_z")})
    mean, sd = df.agg(F.avg(c), F.stddev_pop(c)).first()
    mid = quantiles(df, c, [0.5])[0]
    mad = quantiles(df, F.abs(c - mid), [0.5])[0]
    flags = {
        "by_iqr": (c < low) | (c > high),
        "by_robust_z": (0.6745 * F.abs(c - mid) / mad > 3.5) if mad else F.lit(False),
        "by_z": (F.abs(c - mean) / sd > 3) if sd else F.lit(False),
    }
    marked = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return marked.filter("by_iqr or by_robust_z or by_z")


def drop_impact(df: DataFrame, column: str, other: str) -> DataFrame:
    """What dropping rows without ``column`` does to another column."""
    there, o = F.col(column).isNotNull(), F.col(other)
    return df.agg(
        F.count(F.when(~there, 1)).alias("rows_lost"),
        F.avg(o).alias("mean_before"), F.avg(F.when(there, o)).alias("mean_after"),
        F.median(o).alias("median_before"), F.median(F.when(there, o)).alias("median_after"),
    )


def entity_merge(df: DataFrame, id_column: str, pairs: DataFrame, output: str = "canonical_id") -> DataFrame:
    """Approved pairs ``left_id, right_id`` joined to components; each row gets the smallest id of its own."""
    from .graph import components

    comps = components(pairs.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")))
    return df.join(comps.select(F.col("node").alias(id_column), F.col("component").alias("__c")), id_column, "left").withColumn(output, F.coalesce("__c", F.col(id_column))).drop("__c")


def impact(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``column, nulls_before, nulls_after, changed, removed``: what a change did to each column; ``removed`` rows are those whose key is gone."""
    columns = [c for c in before.columns if c in after.columns and c != key]
    a = before.select(F.col(key).alias("__k"), F.struct(*columns).alias("__a"))
    b = after.select(F.col(key).alias("__m"), F.struct(*columns).alias("__b"))
    both = a.join(b, F.col("__k") == F.col("__m"), "left")
    there = F.col("__m").isNotNull()
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.when(F.col(f"__a.{c}").isNull(), 1)).alias("nulls_before"), F.count(F.when(there & F.col(f"__b.{c}").isNull(), 1)).alias("nulls_after"),
            F.count(F.when(there & ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), 1)).alias("changed"), F.count(F.when(~there, 1)).alias("removed"),
        )
        for c in columns
    ]
    return both.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")

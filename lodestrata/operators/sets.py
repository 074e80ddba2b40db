"""Set operations, differences of snapshots by key, and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import Rejected
from .running import in_ranges


def combine(left: DataFrame, right: DataFrame, how: str, keep_repeats: bool = False) -> DataFrame:
    """``union, intersect`` or ``except`` by the names of columns; nulls are equal to each other.  Names and types must be the same."""
    if sorted(left.dtypes) != sorted(right.dtypes):
        raise Rejected("columns differ")
    right = right.select(*left.columns)
    match how, keep_repeats:
        case "union", False:
            return left.union(right).distinct()
        case "union", True:
            return left.union(right)
        case "intersect", False:
            return left.intersect(right)
        case "intersect", True:
            return left.intersectAll(right)
        case "except", False:
            return left.subtract(right)
        case "except", True:
            return left.exceptAll(right)
    raise Rejected(how)


def difference(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, change`` (added, removed or changed) and ``columns``, those that differ; rows that are the same are left out.

    Keys must tell rows apart on either side.  Null equals null, NaN equals NaN.
    """
    for df in (before, after):
        if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise Rejected("repeated keys")
    values = [c for c in before.columns if c not in keys]
    a = before.select(*[F.col(k).alias(f"__a_{k}") for k in keys], F.struct(*values).alias("__a"))
    b = after.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.struct(*values).alias("__b"))
    same = reduce(lambda x, y: x & y, [F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in keys])
    both = a.join(b, same, "full")
    unlike = F.filter(F.array(*[F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in values]), lambda c: c.isNotNull())
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(unlike) > 0, "changed")
    out = both.select(*[F.coalesce(f"__a_{k}", f"__b_{k}").alias(k) for k in keys], change.alias("change"), F.when(change == "changed", F.concat_ws(",", unlike)).otherwise("").alias("columns"))
    return out.filter("change is not null")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with ``values`` of the latest row of ``right`` of the same ``by`` that isn't later (null: none).

    Rows without a time or a key meet none.  Of right rows of one time the greatest values hold.
    Both sides are dealt out in ranges of their common order, and what a range has to
    know of those before it is one row for each key in it, so no task holds all rows of a hot key.
    """
    names = [f"__{v}" for v in values]
    met = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, time)])
    found = right.filter(met).select(*by, time, F.lit(0).alias("__side"), F.lit(None).cast(left.schema.simpleString()).alias("__l"), F.struct(*[F.col(v).alias(n) for v, n in zip(values, names, strict=True)]).alias("__r"))
    asked = left.filter(met).select(*by, time, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(found.schema["__r"].dataType).alias("__r"))
    both = in_ranges(found.unionByName(asked), [F.col(c) for c in (*by, time, "__side")])
    here = Window.partitionBy("__range", *by).orderBy(time, "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    last = both.groupBy(*by, "__range").agg(F.max(F.when(F.col("__r").isNotNull(), F.struct(F.col(time).alias("t"), F.col("__r").alias("r")))).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "__range", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    out = both.withColumn("__here", F.last("__r", ignorenulls=True).over(here)).filter("__side = 1").join(carried, [*by, "__range"])
    hit = out.select("__l.*", F.coalesce("__here", "__before.r").alias("__hit"))
    full = hit.select(*left.columns, *[F.col(f"__hit.{n}").alias(v) for v, n in zip(values, names, strict=True)])
    lone = left.filter(~F.coalesce(met, F.lit(False)))
    return full.unionByName(lone.select(*left.columns, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]))


def violations(df: DataFrame, rules: dict[str, str], key: str, n: int = 5) -> DataFrame:
    """``rule, key, violations``: for each rule (a condition that must hold) the first ``n`` keys that break it, and how many do.  Null breaks a rule."""
    broken = df.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    count = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    # Spark keeps the first n of each rule within each task before rows move.
    first = broken.withColumn("__k", F.row_number().over(Window.partitionBy("rule").orderBy("key"))).filter(F.col("__k") <= n)
    return first.join(F.broadcast(count), "rule").select("rule", "key", "violations")


def roles(df: DataFrame, unique_share: float = 0.95, few: int = 20) -> DataFrame:
    """``column, role``: identifier, constant, category, measure, time or text, from types and exact counts of distinct values."""
    from pyspark.sql import types as T

    counts = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)], *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)]).first()
    rows = []
    for i, f in enumerate(df.schema):
        n, d = counts[f"n{i}"], counts[f"d{i}"]
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role = "time"
        elif d <= 1:
            role = "constant"
        elif d >= unique_share * n and not isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            role = "identifier"
        elif d <= few:
            role = "category"
        else:
            role = "measure" if isinstance(f.dataType, T.NumericType) else "text"
        rows.append((f.name, role, d))
    return df.sparkSession.createDataFrame(rows, "column string, role string, distinct bigint")

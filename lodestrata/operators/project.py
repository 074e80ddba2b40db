"""Projection, views, sorting and pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formula import compile_formula
from ..functions.values import Rejected, dtype, finite, finite_or_null, literal

ROLES = ("identifier", "category", "measurement", "time", "text", "ordinal", "ignored")


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns or not new.strip() or len(new) > 200 or new.startswith("__"):
        raise Rejected(f"can't rename {old!r} to {new!r}")
    return df.withColumnRenamed(old, new)


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in that order; others are hidden, not gone from the source."""
    if not columns or set(columns) - set(df.columns) or len(set(columns)) != len(columns):
        raise Rejected("columns must exist and be named once")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns or set(columns) - set(df.columns) or len(set(columns)) >= len(df.columns):
        raise Rejected("some but not all columns can be dropped")
    return df.drop(*columns)


def with_role(df: DataFrame, column: str, role: str, unit: str | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Notes what a column means; data stay as they are."""
    if role not in ROLES:
        raise Rejected(role)
    notes = df.schema[column].metadata | {"role": role} | ({"unit": unit} if unit else {}) | ({"order": list(order)} if order else {})
    return df.withMetadata(column, notes)


def computed(df: DataFrame, name: str, formula: str, zero: str = "reject") -> DataFrame:
    if name in df.columns:
        raise Rejected(f"{name!r} is there already")
    return df.withColumn(name, compile_formula(df, formula, zero))


def text_split(df: DataFrame, column: str, delimiter: str, outputs: Sequence[str]) -> DataFrame:
    """By a literal delimiter into 2 to 16 columns; the last keeps the rest, absent ones are null."""
    if not delimiter or not 2 <= len(outputs) <= 16 or set(outputs) & set(df.columns):
        raise Rejected("text_split")
    parts = F.split(F.col(column), re.sub(r"([^\w\s])", r"\\\1", delimiter), len(outputs))
    return df.withColumns({o: F.get(parts, F.lit(i)) for i, o in enumerate(outputs)})


def text_combine(df: DataFrame, columns: Sequence[str], separator: str, output: str, nulls: str = "propagate") -> DataFrame:
    """``propagate``: one null makes the result null; ``skip``: nulls are left out (all null: empty)."""
    joined = F.concat_ws(separator, *[F.col(c) for c in columns])
    if nulls == "propagate":
        any_null = F.lit(False)
        for c in columns:
            any_null = any_null | F.col(c).isNull()
        joined = F.when(~any_null, joined)
    elif nulls != "skip":
        raise Rejected(nulls)
    return df.withColumn(output, joined)


def date_parts(df: DataFrame, column: str, parts: Sequence[str], timezone: str | None = None) -> DataFrame:
    """Columns ``<column>_<part>``: ISO week and weekday (Monday is 1), quarter and so on."""
    c = F.col(column)
    if timezone:
        c = F.from_utc_timestamp(c, timezone)
    known = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": lambda x: F.weekday(x) + 1, "week": F.weekofyear,
        "quarter": F.quarter, "hour": F.hour, "minute": F.minute,
    }
    return df.withColumns({f"{column}_{p}": known[p](c) for p in parts})


PREDICATES = ("eq", "ne", "gt", "ge", "lt", "le", "contains", "is_null", "not_null", "is_nan", "is_inf")


def predicate(df: DataFrame, column: str, op: str, value: object = None) -> Column:
    """A typed condition.  An unknown result counts as no; on floats, comparisons hold for finite values only.

    The condition isn't wrapped, so it reaches the scan.
    """
    c, t = F.col(column), dtype(df, column)
    if op not in PREDICATES:
        raise Rejected(op)
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op in ("is_nan", "is_inf"):
        if not isinstance(t, (T.FloatType, T.DoubleType)):
            raise Rejected(f"{op} is for floats")
        return F.isnan(c) if op == "is_nan" else F.abs(c) == float("inf")
    if op == "contains":
        if not isinstance(t, T.StringType):
            raise Rejected("contains is for text")
        return F.contains(c, F.lit(str(value)))
    v = literal(value, t)
    test = {"eq": c == v, "ne": c != v, "gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[op]
    return test & finite(c, t) if isinstance(t, (T.FloatType, T.DoubleType)) else test


def where(df: DataFrame, *conditions: tuple) -> DataFrame:
    """Rows that meet all of at most 8 conditions ``(column, op[, value])``."""
    if len(conditions) > 8:
        raise Rejected("at most 8 conditions")
    for c in conditions:
        df = df.filter(predicate(df, *c))
    return df


def within(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values of a list of at most 1000; null in the list matches null."""
    if len(values) > 1000:
        raise Rejected("at most 1000 values")
    c = F.col(column)
    test = c.isin([v for v in values if v is not None])
    return df.filter(test | c.isNull() if None in values else test)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with the given ids, all of which must be there."""
    missing = ids.select(key).distinct().join(df.select(key), key, "left_anti").count()
    if missing:
        raise Rejected(f"{missing} ids aren't there")
    return df.join(ids.select(key).distinct(), key, "left_semi")


def sort(df: DataFrame, column: str, ordinal: str, descending: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """Stable: nulls (and NaN) last either way, ties in the order of ``ordinal``; ``order`` ranks the values of an ordinal scale."""
    t = dtype(df, column)
    key = finite_or_null(F.col(column), t) if isinstance(t, (T.FloatType, T.DoubleType)) else F.col(column)
    if order:
        key = F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), key), F.lit(0).cast("bigint"))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(ordinal).asc())


def page(df: DataFrame, number: int, size: int = 200, width: int = 256) -> DataFrame:
    """One page of an ordered frame; long texts are cut for display."""
    shown = [F.substring(F.col(f.name), 1, width).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    return df.offset(number * size).limit(size).select(*shown)


def first_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    return df.orderBy(ordinal).limit(n)

"""Policy for special values: null, NaN, infinities, white space, casts.

Null and NaN are never the same thing.  Predicates and statistics leave out
null, NaN and infinities; comparisons for grouping take -0 as 0.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from decimal import Decimal, InvalidOperation
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = {"tinyint": (-128, 127), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}


class Rejected(ValueError):
    """Data or a specification doesn't meet a policy; nothing is repaired in silence."""


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def finite(c: Column, t: T.DataType) -> Column:
    """True for finite values; never wrapped, so that it can be pushed to a scan."""
    return c.isNotNull() if not is_float(t) else c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or_null(c: Column, t: T.DataType) -> Column:
    return F.when(finite(c, t), c) if is_float(t) else c


def strip(c: Column, side: str = "both") -> Column:
    """White space of any script from the ends."""
    pattern = {"both": r"(?U)^\s+|\s+$", "left": r"(?U)^\s+", "right": r"(?U)\s+$"}[side]
    return F.regexp_replace(c, pattern, "")


def fold(c: Column) -> Column:
    """Lower case with the Turkish letters I and İ told apart, stripped."""
    return strip(F.lower(F.translate(c, "Iİ", "ıi")))


def require_finite(df: DataFrame, columns: list[str], what: str) -> None:
    """Raises if a floating key or measure holds NaN or an infinity: one small aggregate, no rows move."""
    checks = [F.count(F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 1)).alias(c) for c in columns if is_float(dtype(df, c))]
    if checks and (bad := {k: v for k, v in df.agg(*checks).first().asDict().items() if v}):
        raise Rejected(f"{what}: non-finite values in {bad}")


def literal(value: object, t: T.DataType) -> Column:
    """A literal of exactly that type, or ``Rejected`` if the text would lose something."""
    text = str(value)
    kind = t.simpleString()
    try:
        if kind in INTEGERS:
            low, high = INTEGERS[kind]
            if not re.fullmatch(r"[+-]?\d+", text) or not low <= int(text) <= high:
                raise Rejected(f"{text!r} is no {kind}")
        elif isinstance(t, T.DecimalType):
            d = Decimal(text)
            if not d.is_finite() or d != round(d, t.scale) or len(str(abs(int(d)))) > t.precision - t.scale and abs(d) >= 1:
                raise Rejected(f"{text!r} doesn't fit {kind}")
        elif is_float(t):
            d = Decimal(text)
            if not d.is_finite():
                raise Rejected(f"{text!r} isn't finite")
            if d == d.to_integral_value() and Decimal(float(text)) != d:
                raise Rejected(f"{text!r} loses digits as {kind}")
        elif kind == "boolean":
            if text.lower() not in ("true", "false"):
                raise Rejected(f"{text!r} is no boolean")
        elif kind == "date":
            dt.date.fromisoformat(text)
        elif kind in ("timestamp", "timestamp_ntz"):
            dt.datetime.fromisoformat(text)
        elif kind != "string":
            raise Rejected(f"no literals of type {kind}")
    except (InvalidOperation, ValueError) as e:
        raise e if isinstance(e, Rejected) else Rejected(f"{text!r} is no {kind}") from e
    return F.lit(text).cast(t)


def exact_cast(c: Column, source: T.DataType, target: str, date_format: str | None = None, truth: tuple[str, str] = ("true", "false")) -> Column:
    """Cast that gives null where something would be lost: a fraction, digits of a scale, an impossible date."""
    plain = c.cast("string")
    if target == "string":
        return plain
    if target == "boolean":
        low = F.lower(strip(plain))
        return F.when(low == truth[0], F.lit(True)).when(low == truth[1], F.lit(False))
    if target == "date" and isinstance(source, T.StringType):
        return F.try_to_timestamp(strip(c), F.lit(date_format or "yyyy-MM-dd")).cast("date")
    if target in ("timestamp", "timestamp_ntz") and isinstance(source, T.StringType):
        return (F.try_to_timestamp(strip(c), F.lit(date_format)) if date_format else F.try_to_timestamp(strip(c))).cast(target)
    if isinstance(source, T.StringType):
        text = strip(c)
        if target in INTEGERS:
            return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(target))
        if target in ("double", "float"):
            number = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast(target))
            return F.when(F.abs(number) != float("inf"), number)
        number = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text.try_cast("decimal(38,18)"))
        return F.when(number.try_cast(target).cast("decimal(38,18)") == number, number.try_cast(target))
    out = c.try_cast(target)
    back = out.try_cast(source)
    return F.when(back == c, out)


def nfkc_fold(c: Column) -> Column:
    """Compatibility form, case folded, stripped: names are compared by it."""
    @F.arrow_udf("string")
    def folded(data: pa.Array) -> pa.Array:
        return pa.array([None if s is None else unicodedata.normalize("NFKC", s).casefold().strip() for s in data.to_pylist()], pa.string())

    return folded(c.cast("string"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Likeness from 0 to 1 by longest matching blocks: twice the matched characters over both lengths."""
    @F.arrow_udf("double")
    def ratio(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return ratio(a, b)

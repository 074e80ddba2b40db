"""Personal data in tables: scans of columns, and projections by policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Rejected

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![\p{L}\p{N}_-])\+?[0-9][0-9 ()]{8,}[0-9](?![\p{L}\p{N}_-])"
SECRET = r"(?i)(password|secret|token|api_key)\s*[=:]"
NAMES = r"(?i)mail|phone|tel|pass|secret|token|ssn|iban"


def scan(df: DataFrame) -> DataFrame:
    """``column, emails, phones, secrets, name_hint`` of text columns, from one pass."""
    parts = []
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            n = lambda p: F.count(F.when(c.rlike(p), 1))  # noqa: B023, E731
            parts.append(F.struct(F.lit(f.name).alias("column"), n(EMAIL).alias("emails"), n(PHONE).alias("phones"), n(SECRET).alias("secrets"), F.lit(f.name).rlike(NAMES).alias("name_hint")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def project(df: DataFrame, policy: dict[str, str], key: str = "") -> DataFrame:
    """``mask``, ``drop``, ``pseudonym`` (keyed SHA-256) or ``keep`` for each column; nulls stay null; columns are renamed ``column_1`` and on."""
    out = []
    for name in df.columns:
        c, how = F.col(f"`{name}`"), policy.get(name, "mask")
        if how == "keep":
            if df.schema[name].dataType == T.StringType() and df.filter(c.rlike(SECRET)).limit(1).count():
                raise Rejected(f"{name!r} looks like a secret")
            out.append(c)
        elif how == "mask":
            out.append(F.when(c.isNotNull(), F.lit("[redacted]")))
        elif how == "pseudonym":
            if not key:
                raise Rejected("a key is needed")
            inner = F.sha2(F.concat(F.lit(key), F.lit("|"), c.cast("string")), 256)
            out.append(F.when(c.isNotNull(), F.sha2(F.concat(F.lit(key), F.lit("|"), inner), 256)))
        elif how != "drop":
            raise Rejected(how)
    return df.select(*[c.alias(f"column_{i}") for i, c in enumerate(out, 1)])

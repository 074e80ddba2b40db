"""Data quality: findings, rules, contracts, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Rejected, dtype, exact_cast, finite, fold, is_float, sequence_ratio

BLANKS = r"(?U)^\s*$|^\s|\s$|  |[\t\n\r]"


def scan(df: DataFrame) -> DataFrame:
    """``column, missing, nonfinite, whitespace, distinct_at_most_one``, from one pass over all columns."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        n = lambda cond: F.count(F.when(cond, 1))
        odd = n(F.isnan(c) | (F.abs(c) == float("inf"))) if is_float(f.dataType) else F.lit(0).cast("bigint")
        blank = n(c.rlike(BLANKS)) if isinstance(f.dataType, T.StringType) else F.lit(0).cast("bigint")
        constant = (F.min(c) == F.max(c)) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else F.lit(None).cast("boolean")
        parts.append(F.struct(F.lit(f.name).alias("column"), n(c.isNull()).alias("missing"), odd.alias("nonfinite"), blank.alias("whitespace"), F.coalesce(constant, F.lit(False)).alias("constant")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All members of groups of more than one row.  Counts combine before the shuffle; the join to them can be split if a key is hot."""
    counts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("group_rows")).filter("group_rows > 1")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(counts, cond).drop(*[f"__{k}" for k in keys])


def violation(df: DataFrame, rule: dict) -> Column:
    """Whether a row breaks a row rule.  Null passes all but ``required`` and ``nullable``."""
    c, t = F.col(rule["column"]), dtype(df, rule["column"])
    match rule["kind"]:
        case "required":
            return c.isNull() | (c.rlike(r"(?U)^\s*$") if isinstance(t, T.StringType) else F.lit(False))
        case "nullable":
            return c.isNull() if not rule.get("allowed", False) else F.lit(False)
        case "range":
            low, high = rule.get("min"), rule.get("max")
            bad = F.lit(False)
            if low is not None:
                bad = bad | (c < F.lit(low))
            if high is not None:
                bad = bad | (c > F.lit(high))
            return F.coalesce(bad | ~finite(c, t) & c.isNotNull(), F.lit(False))
        case "allowed" | "ordinal":
            return F.coalesce(~c.isin(rule["values"]), F.lit(False))
        case "number":
            return c.isNotNull() & exact_cast(c, t, "double").isNull()
        case "date":
            return c.isNotNull() & exact_cast(c, t, "date", rule.get("format")).isNull()
        case "convert":
            return c.isNotNull() & exact_cast(c, t, rule["target"], rule.get("format")).isNull()
    raise Rejected(f"no row rule {rule['kind']!r}")


ROW_RULES = ("required", "nullable", "range", "allowed", "ordinal", "number", "date", "convert")


def evaluate(df: DataFrame, rules: list[dict], references: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rule, kind, scope, severity, violations`` for each rule; row rules share one pass."""
    spark = df.sparkSession
    names = [r.get("name", f"{r['kind']}:{r.get('column', '')}") for r in rules]
    row = [i for i, r in enumerate(rules) if r["kind"] in ROW_RULES]
    counts: dict[int, int] = {}
    if row:
        got = df.agg(*[F.count(F.when(violation(df, rules[i]), 1)).alias(f"r{i}") for i in row]).first()
        counts |= {i: got[f"r{i}"] for i in row}
    scope = {}
    for i, r in enumerate(rules):
        if i in counts:
            scope[i] = "row"
            continue
        match r["kind"]:
            case "unique":
                c = F.col(r["column"])
                groups = (df if r.get("nulls_equal") else df.filter(c.isNotNull())).groupBy(r["column"]).count().filter("count > 1")
                counts[i], scope[i] = groups.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], "column"
            case "type":
                counts[i], scope[i] = int(dtype(df, r["column"]).simpleString() != r["type"]), "column"
            case "unit":
                counts[i], scope[i] = int(df.schema[r["column"]].metadata.get("unit") != r["unit"]), "column"
            case "row_count":
                n = df.count()
                counts[i], scope[i] = int(not r.get("min", 0) <= n <= r.get("max", n)), "table"
            case "foreign_key":
                ref = (references or {})[r["reference"]]
                if dtype(df, r["column"]) != dtype(ref, r["key"]) or ref.groupBy(r["key"]).count().filter("count > 1").limit(1).count():
                    counts[i], scope[i] = 1, "table"
                else:
                    rows = df if not r.get("nullable", True) else df.filter(F.col(r["column"]).isNotNull())
                    counts[i], scope[i] = rows.join(ref.select(F.col(r["key"]).alias("__k")), F.col(r["column"]) == F.col("__k"), "left_anti").count(), "cross_table"
            case other:
                raise Rejected(f"no rule {other!r}")
    rows = [(names[i], r["kind"], scope[i], r.get("severity", "error"), int(counts[i])) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule string, kind string, scope string, severity string, violations bigint")


def quarantine(df: DataFrame, rules: list[dict], policy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows have ``violations``, the names of the rules broken; ``stop`` refuses any, ``warn`` keeps all."""
    if any(r["kind"] not in ROW_RULES for r in rules):
        raise Rejected("only row rules can be set apart")
    broken = F.filter(F.array(*[F.when(violation(df, r), F.lit(r.get("name", f"{r['kind']}:{r['column']}"))) for r in rules]), lambda x: x.isNotNull())
    marked = df.withColumn("violations", broken)
    bad = marked.filter(F.size("violations") > 0)
    if policy == "stop" and bad.limit(1).count():
        raise Rejected("rows break rules")
    return (df if policy == "warn" else marked.filter(F.size("violations") == 0).drop("violations")), bad


def similar_categories(df: DataFrame, column: str, threshold: float = 0.85, limit: int = 200) -> DataFrame:
    """Pairs of categories that may be the same: equal when folded, or alike and at least 4 characters long.

    The most frequent ``limit`` categories are compared; it's a report for people.
    """
    top = df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.col("count").desc(), column).limit(limit).select(F.col(column).alias("v"), fold(F.col(column)).alias("f"))
    a, b = top.select(F.col("v").alias("a"), F.col("f").alias("fa")), top.select(F.col("v").alias("b"), F.col("f").alias("fb"))
    ratio = sequence_ratio(F.col("fa"), F.col("fb"))
    long = F.least(F.char_length("fa"), F.char_length("fb")) >= 4
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", ratio.alias("similarity"), (F.col("fa") == F.col("fb")).alias("same_folded"), long.alias("long")).filter(F.col("same_folded") | (F.col("similarity") >= threshold) & F.col("long")).drop("long")

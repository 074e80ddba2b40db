"""Writers: versions as Parquet, exports with escapes, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Rejected

DANGER = r"^[=+@\-\t\r]"


def escaped(df: DataFrame, null: str = r"\N") -> DataFrame:
    """For spreadsheets: texts that would run as formulas get a quote in front; nulls get a marker."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.rlike(DANGER), F.concat(F.lit("'"), c)).otherwise(c)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit(null)).alias(f.name))
    return df.select(*out)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of row hashes that doesn't depend on order."""
    cols = [F.to_json(F.struct(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema]
    n, h = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def publish(df: DataFrame, root: str, version: str) -> DataFrame:
    """A new version, never overwritten; read back and checked."""
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("error").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if fingerprint(back) != fingerprint(df):
        raise Rejected("what was written differs")
    return back


def export(df: DataFrame, path: str, kind: str) -> None:
    match kind:
        case "csv":
            escaped(df).write.option("header", True).option("escape", '"').csv(path)
        case "json" | "jsonl":
            df.write.option("ignoreNullFields", False).json(path)
        case "parquet":
            df.write.parquet(path)
        case "orc":
            df.write.orc(path)
        case _:
            raise Rejected(kind)

"""Readers: delimited text with quarantine, JSON, workbooks, SQLite, fixed width, Arrow, statistics files."""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.values import Rejected, strip

NULLS = ("", "NA", "N/A", "null", "NULL")


def delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """All columns as text, so that leading zeros stay; types come with ``typed``."""
    return spark.read.option("sep", delimiter).option("encoding", encoding).option("header", header).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", False).csv(path)


def quarantined(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", header_row: int = 0, skip_blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows as text, rows that have another number of fields than the header: ``file, line, fields, reason``).

    A record is a line; quotes may hold delimiters and doubled quotes, and a quote that isn't closed is a reason too.
    Names are those of the line ``header_row`` (from 0) of the first file; each file's lines up to it are left out.
    """
    from functools import reduce
    from operator import or_

    lines = spark.read.option("lineSep", "\n").text(path) if encoding.upper() in ("UTF-8", "UTF8") else _decoded(spark, path, encoding)
    lines = lines.select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file") if "file" not in lines.columns else F.col("file"))
    head = [r.line.removeprefix("\ufeff") for r in lines.limit(header_row + 1).collect()]
    if len(head) <= header_row:
        raise Rejected("no header")
    import csv

    names = next(csv.reader([head[header_row]], delimiter=delimiter))
    names = [n.strip() or f"column_{i + 1}" for i, n in enumerate(names)]
    if len(set(names)) != len(names):
        raise Rejected("two columns of one name")
    skipped = reduce(or_, [F.col("line") == h for h in head], F.col("line") == "\ufeff" + head[0])
    body = lines.filter(~skipped)
    if skip_blank:
        body = body.filter(F.trim("line") != "")
    # A quoted field stands alone between delimiters; what is left of quotes then was never closed.
    d = re.escape(delimiter)
    masked = F.regexp_replace("line", rf'(?<=^|{d})"(?:[^"]|"")*+"(?=$|{d})', "q")
    marked = body.withColumn("fields", F.size(F.split(masked, d, -1))).withColumn(
        "reason",
        F.when(F.regexp_like(masked, F.lit(rf'(^|{d})"')), "open quote").when(F.col("fields") < len(names), "short").when(F.col("fields") > len(names), "long"),
    )
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": ""}
    good = marked.filter("reason is null").select(F.from_csv("line", schema, options).alias("r")).select(*[F.coalesce(f"r.c{i}", F.lit("")).alias(n) for i, n in enumerate(names)])
    return good, marked.filter("reason is not null").select("file", "line", "fields", "reason")


def _decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of files in an encoding of one byte a character: the newline is the same byte in all of them."""
    raw = spark.read.option("lineSep", "\n").text(path)  # as bytes: Spark's text reader decodes nothing
    upper = bytes(range(128, 256))
    meant = "".join(bytes([b]).decode(encoding, "replace") for b in upper)
    return raw.select(F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), upper.decode("latin-1"), meant).alias("value"), F.col("_metadata.file_path").alias("file"))


def _number(c: Column, decimal: str, thousands: str) -> Column:
    out = F.replace(c, F.lit(thousands), F.lit("")) if thousands else c
    return F.replace(out, F.lit(decimal), F.lit(".")) if decimal != "." else out


def parsed(c: Column, kind: str, decimal: str = ".", thousands: str = "", date_format: str = "yyyy-MM-dd", nulls: Sequence[str] = NULLS) -> Column:
    """Value of a text as ``kind``; null markers are null; what doesn't parse is null too (tell apart with ``bad``)."""
    text = strip(c)
    text = F.when(~text.isin(list(nulls)), text)
    plain = _number(text, decimal, thousands)
    match kind:
        case "text":
            return F.when(~c.isin(list(nulls)), c)
        case "int64":
            return F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))
        case "float64":
            return F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
        case "decimal":
            return F.when(plain.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,6})?$"), plain.try_cast("decimal(38,6)"))
        case "date":
            return F.try_to_timestamp(text, F.lit(date_format)).cast("date")
        case "datetime":
            return F.try_to_timestamp(text).cast("timestamp_ntz")
        case "boolean":
            low = F.lower(text)
            return F.when(low.isin("true", "evet", "1"), F.lit(True)).when(low.isin("false", "hayır", "0"), F.lit(False))
    raise Rejected(kind)


def typed(df: DataFrame, kinds: dict[str, str], bad_rows: str = "stop", **options) -> tuple[DataFrame, DataFrame]:
    """(good rows with types, bad rows as text with ``bad_columns``); ``stop`` refuses bad rows."""
    nulls = list(options.get("nulls", NULLS))
    values = {c: parsed(F.col(f"`{c}`"), k, **options) for c, k in kinds.items()}
    bad = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull() & ~strip(F.col(f"`{c}`")).isin(nulls) & v.isNull(), F.lit(c)) for c, v in values.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("bad_columns", bad)
    wrong = marked.filter(F.size("bad_columns") > 0)
    if bad_rows == "stop" and wrong.limit(1).count():
        raise Rejected("rows that don't parse")
    return marked.filter(F.size("bad_columns") == 0).select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in df.columns]), wrong


def infer(df: DataFrame, **options) -> dict[str, str]:
    """Kind of each text column, from all rows in one pass: boolean, int64, decimal, date, else text; codes with leading zeros are text."""
    nulls = list(options.get("nulls", NULLS))
    order = ("boolean", "int64", "decimal", "date")
    checks = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        there = col.isNotNull() & ~strip(col).isin(nulls)
        checks.append(F.count(F.when(there, 1)).alias(f"n{i}"))
        checks.append(F.count(F.when(there & strip(col).rlike(r"^0[0-9]+$"), 1)).alias(f"z{i}"))
        checks += [F.count(F.when(there & parsed(col, k, **options).isNull(), 1)).alias(f"{k}{i}") for k in order]
    got = df.agg(*checks).first()
    return {c: "text" if not got[f"n{i}"] or got[f"z{i}"] else next((k for k in order if not got[f"{k}{i}"]), "text") for i, c in enumerate(df.columns)}


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines): one parser says which is which, so each line is in one of them."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    if schema is None:
        found = spark.read.option("columnNameOfCorruptRecord", "__bad").json(path).schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found if f.name != "__bad")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed_ = lines.select("value", F.from_json("value", f"{schema}, `__bad` string" if schema else "`__bad` string", options).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    return parsed_.filter(~bad).select("r.*").drop("__bad"), parsed_.filter(bad).select("value")


def json_document(spark: SparkSession, path: str, pointer: str = "") -> DataFrame:
    """Records of one document, at a JSON pointer."""
    if pointer:
        steps = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p.replace('~1', '/').replace('~0', '~')}']" for p in pointer.strip("/").split("/"))
        rows = spark.read.text(path, wholetext=True).select(F.get_json_object("value", steps).alias("v"))
        kind = rows.select(F.schema_of_json(F.lit(rows.first()[0]))).first()[0]
        # Fields that only other files have count too.
        for r in rows.select(F.col("v")).offset(1).toLocalIterator():
            if r[0] is not None and (other := rows.limit(1).select(F.schema_of_json(F.lit(r[0]))).first()[0]) != kind:
                kind = _merged_kind(kind, other)
        out = rows.select(F.from_json("v", kind).alias("r"))
        return out.select(F.explode("r").alias("r")).select("r.*") if kind.upper().startswith("ARRAY") else out.select("r.*")
    return spark.read.option("multiLine", True).json(path)


def _merged_kind(a: str, b: str) -> str:
    """The JSON schema with the fields of both; a field of two kinds is text."""

    def merge(x: T.DataType, y: T.DataType) -> T.DataType:
        if isinstance(x, T.ArrayType) and isinstance(y, T.ArrayType):
            return T.ArrayType(merge(x.elementType, y.elementType))
        if isinstance(x, T.StructType) and isinstance(y, T.StructType):
            there = {f.name: f.dataType for f in x}
            for f in y:
                there[f.name] = merge(there[f.name], f.dataType) if f.name in there else f.dataType
            return T.StructType([T.StructField(k, v) for k, v in there.items()])
        return x if x == y else T.DoubleType() if {x, y} == {T.LongType(), T.DoubleType()} else T.StringType()

    kind = merge(T.DataType.fromDDL(a), T.DataType.fromDDL(b))
    return kind.simpleString()


def flatten(df: DataFrame, limit: int = 256) -> DataFrame:
    """Nested objects become columns ``/a/b``."""

    def walk(fields: T.StructType, path: tuple[str, ...]) -> Iterator[Column]:
        for f in fields:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, at)
            else:
                yield F.col(".".join(f"`{p}`" for p in at)).alias("/" + "/".join(at) if path else f.name)

    columns = list(walk(df.schema, ()))
    if len(columns) > limit:
        raise Rejected(f"over {limit} columns")
    return df.select(*columns)


def expand_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each element of the lists (all combinations); an empty or missing one keeps the row, with a null index."""
    for c in columns:
        rest = [F.col(f"`{x}`") for x in df.columns if x != c]
        df = df.select(*rest, F.posexplode_outer(F.col(f"`{c}`")).alias(f"{c}_index", c))
    return df


def fixed_width(spark: SparkSession, path: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """``fields``: name to (start from 0, length), in characters."""
    return spark.read.text(path).select(*[F.substring("value", a + 1, n).alias(name) for name, (a, n) in fields.items()])


def xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def parquet_parts(spark: SparkSession, path: str) -> DataFrame:
    """A directory of parts: partition columns found, schemas merged."""
    return spark.read.option("mergeSchema", True).parquet(path)


def columnar(spark: SparkSession, path: str, kind: str = "orc") -> DataFrame:
    """ORC (or Parquet) files, schemas merged; columns and filters are pushed into the scan."""
    return spark.read.format(kind).option("mergeSchema", True).load(path)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """``geometry_type, coordinates`` (JSON) and properties of features."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    return doc.select(F.get_json_object("f", "$.geometry.type").alias("geometry_type"), F.get_json_object("f", "$.geometry.coordinates").alias("coordinates"), F.get_json_object("f", "$.properties").alias("properties"))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows, through Spark's own reader, so any store works."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _by_file(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """One file a task; ``read`` turns its bytes into record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                yield from read(content)

    return _binary(spark, path).mapInArrow(run, schema)


def _schema(table: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_arrow_schema(table))


def arrow_ipc(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    opened = (lambda c: pa.ipc.open_stream(io.BytesIO(c))) if stream else (lambda c: pa.ipc.open_file(io.BytesIO(c)))
    first = bytes(_binary(spark, path).first().content)
    schema = _schema(opened(first).schema)

    def read(content: bytes) -> Iterator[pa.RecordBatch]:
        r = opened(content)
        yield from (r if stream else (r.get_batch(i) for i in range(r.num_record_batches)))

    return _by_file(spark, path, read, schema)


def statistical(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``stata`` or ``sas`` (XPORT, SAS7BDAT) files."""

    def frame(content: bytes) -> pd.DataFrame:
        if kind == "stata":
            return pd.read_stata(io.BytesIO(content), convert_categoricals=False)
        return pd.read_sas(io.BytesIO(content), format="xport" if content[:20].startswith(b"HEADER RECORD") else "sas7bdat", encoding="utf-8")

    first = pa.RecordBatch.from_pandas(frame(bytes(_binary(spark, path).first().content)), preserve_index=False)
    return _by_file(spark, path, lambda c: [pa.RecordBatch.from_pandas(frame(c), preserve_index=False)], _schema(first.schema))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cell_column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Cells of a sheet as texts, with the standard library alone; formulas give their stored values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_MAIN}row"):
            out: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _cell_column(c.get("r", "A1"))
                out += [None] * (at + 1 - len(out))
                v = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    out[at] = shared[int(v.text)] if c.get("t") == "s" else {"0": "false", "1": "true"}[v.text] if c.get("t") == "b" else v.text
            yield out


_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"


def ods_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tables = list(ElementTree.fromstring(z.read("content.xml")).iter(f"{_TABLE}table"))
    blank = 0
    for row in tables[sheet - 1].iter(f"{_TABLE}table-row"):
        out: list[str | None] = []
        held = 0
        for c in row.iter(f"{_TABLE}table-cell"):
            text = "\n".join("".join(p.itertext()) for p in c.iter(f"{_TEXT}p"))
            value = c.get(f"{_OFFICE}value") or c.get(f"{_OFFICE}date-value") or c.get(f"{_OFFICE}boolean-value") or text or None
            repeated = int(c.get(f"{_TABLE}number-columns-repeated", "1"))
            if value is None:
                held += repeated  # written out only if a value follows: sheets end in empty cells up to their widest
            else:
                out += [None] * held + [value] * repeated
                held = 0
        times = int(row.get(f"{_TABLE}number-rows-repeated", "1"))
        if not out:
            blank += times  # likewise for rows
            continue
        for _ in range(blank):
            yield []
        blank = 0
        for _ in range(times):
            yield list(out)


def workbook(spark: SparkSession, path: str, kind: str = "xlsx", sheet: int = 1) -> DataFrame:
    """First row: names; all columns as text (then ``infer`` and ``typed``)."""
    rows_of = {"xlsx": xlsx_rows, "ods": ods_rows}[kind]
    names = next(rows_of(bytes(_binary(spark, path).first().content), sheet))
    names = [n or f"column_{i + 1}" for i, n in enumerate(names)]

    def read(content: bytes) -> Iterator[pa.RecordBatch]:
        rows = list(rows_of(content, sheet))[1:]
        data = [[r[i] if i < len(r) else None for r in rows] for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()) for d in data], names=names)

    return _by_file(spark, path, read, ", ".join(f"`{n}` string" for n in names))


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite")`` with options ``path`` and ``table``; a file that all workers see.

    ``columns`` (names, comma-separated) and ``where`` (SQL) are left to the database.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f"PRAGMA table_info('{self.options['table']}')").fetchall()
        if wanted := _names(self.options):
            by_name = {r[1]: r for r in rows}
            rows = [by_name[n] for n in wanted]
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double", "BLOB": "binary"}
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper().split('(')[0], 'string')}" for r in rows)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SQLiteReader(self.options)


class _SQLiteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", 4))
        self.columns, self.where = _names(options), options.get("where")

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids; a table without them is read whole."""
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:
                return [InputPartition(None)]
        if low is None:
            return [InputPartition(None)]
        step = (high - low) // self.parts + 1
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3 as db_

        what = ", ".join(f'"{c}"' for c in self.columns) or "*"
        tests = ([f"({self.where})"] if self.where else []) + (["rowid BETWEEN ? AND ?"] if partition.value else [])
        with db_.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {what} FROM "{self.table}"' + (" WHERE " + " AND ".join(tests) if tests else ""), partition.value or ())


def _names(options: dict) -> list[str]:
    return [c for c in options.get("columns", "").split(",") if c]


def _loaded(spark: SparkSession, source: type[DataSource], path: str, table: str, columns: Sequence[str], where: str | None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path).option("table", table).option("columns", ",".join(columns))
    return (reader.option("where", where) if where else reader).load()


def sqlite(spark: SparkSession, path: str, table: str, columns: Sequence[str] = (), where: str | None = None) -> DataFrame:
    return _loaded(spark, SQLiteSource, path, table, columns, where)


class DuckDBSource(DataSource):
    """As ``SQLiteSource``, for a DuckDB file; it is read in ranges of row ids, as Arrow batches."""

    @classmethod
    def name(cls) -> str:
        return "duckdb"

    def _what(self) -> str:
        return ", ".join(f'"{c}"' for c in _names(self.options)) or "*"

    def schema(self) -> str:
        import duckdb

        with duckdb.connect(self.options["path"], read_only=True) as db:
            return _schema(db.sql(f'SELECT {self._what()} FROM "{self.options["table"]}" LIMIT 0').to_arrow_table().schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _DuckDBReader(self.options, self._what())


class _DuckDBReader(DataSourceReader):
    def __init__(self, options: dict, what: str):
        self.path, self.table, self.parts, self.what, self.where = options["path"], options["table"], int(options.get("parts", 4)), what, options.get("where")

    def partitions(self) -> list[InputPartition]:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as db:
            high = db.sql(f'SELECT coalesce(max(rowid), -1) FROM "{self.table}"').fetchall()[0][0]
        step = (high + 1) // self.parts + 1
        return [InputPartition((a, a + step)) for a in range(0, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import duckdb

        a, b = partition.value
        tests = [f"rowid >= {a} AND rowid < {b}"] + ([f"({self.where})"] if self.where else [])
        with duckdb.connect(self.path, read_only=True) as db:
            yield from db.sql(f'SELECT {self.what} FROM "{self.table}" WHERE {" AND ".join(tests)}').to_arrow_table().to_batches()


def duckdb_table(spark: SparkSession, path: str, table: str, columns: Sequence[str] = (), where: str | None = None) -> DataFrame:
    return _loaded(spark, DuckDBSource, path, table, columns, where)


def database(spark: SparkSession, url: str, table: str, properties: dict[str, str], partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """JDBC; filters, columns and limits are pushed to the server.  ``partition``: column, low, high, number."""
    if partition:
        column, low, high, n = partition
        return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=n, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)

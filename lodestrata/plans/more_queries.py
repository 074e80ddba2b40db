"""Queries of sources, set operations and as-of joins; files are written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts, cleaning, monitor, profile, project, relational, sets, windows
from ..operators.running import scratch
from ..sources import readers, sinks
from ..streaming import streams
from .queries import query


def _local(path: str) -> str:
    """A path for libraries that open files themselves."""
    return path.removeprefix("file://")


def _nested(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("at")).alias("who"), F.split("c_mktsegment", "I").alias("parts"))


@query("SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(38,6)) AS c_acctbal, c_mktsegment FROM customer", "customer")
def source_csv_typed(customer):
    at = scratch(customer.sparkSession)
    customer.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint")).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")).write.option("header", True).csv(f"{at}/t")
    read = readers.delimited(customer.sparkSession, f"{at}/t")
    kinds = {"c_custkey": "int64", "c_name": "text", "c_nationkey": "int64", "c_acctbal": "decimal", "c_mktsegment": "text"}
    return readers.typed(read, kinds)[0].withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


_LINES = "SELECT p_partkey, p_partkey || ';' || '\"' || p_name || '; \"\"x\"\"' || '\"' || CASE WHEN p_partkey % 10 = 3 THEN '' WHEN p_partkey % 10 = 4 THEN ';1;2' ELSE ';1' END AS line FROM part"


def _lines(part: DataFrame) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 10 == 3, "").when(F.col("p_partkey") % 10 == 4, ";1;2").otherwise(";1")
    body = part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(';"'), "p_name", F.lit('; ""x"""'), tail).alias("value"))
    at = f"{scratch(part.sparkSession)}/t"
    part.sparkSession.range(1).select(F.lit("key;name;n").alias("value")).unionByName(body).coalesce(1).write.text(at)
    return readers.quarantined(part.sparkSession, at, ";")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || '; \"x\"' AS name, '1' AS n FROM part WHERE p_partkey % 10 NOT IN (3, 4)", "part")
def source_csv_good_rows(part):
    return _lines(part)[0]


@query(f"SELECT line, CASE WHEN p_partkey % 10 = 3 THEN 2 ELSE 4 END AS fields, CASE WHEN p_partkey % 10 = 3 THEN 'short' ELSE 'long' END AS reason FROM ({_LINES}) WHERE p_partkey % 10 IN (3, 4)", "part")
def source_csv_quarantine(part):
    return _lines(part)[1].select("line", "fields", "reason")


@query("SELECT 'b' AS \"column\", 'boolean' AS kind UNION ALL SELECT 'c', 'text' UNION ALL SELECT 'd', 'date' UNION ALL SELECT 'k', 'int64' UNION ALL SELECT 'm', 'decimal' UNION ALL SELECT 'z', 'text'", "orders")
def source_inference(orders):
    spark = orders.sparkSession
    at = f"{scratch(spark)}/t"
    rows = orders.select((F.col("o_custkey") % 2 == 0).alias("b"), F.col("o_orderpriority").alias("c"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("m"), F.format_string("0%d", "o_orderkey").alias("z"))
    rows.write.option("header", True).option("sep", "\t").csv(at)
    kinds = readers.infer(readers.delimited(spark, at, "\t"))
    return spark.createDataFrame(list(kinds.items()), "column string, kind string")


def _jsonl(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = f"{scratch(orders.sparkSession)}/t"
    orders.select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('{"k": '), F.col("o_orderkey").cast("string"))).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("value")).write.text(at)
    return readers.json_lines(orders.sparkSession, at)


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0", "orders")
def source_jsonl(orders):
    return _jsonl(orders)[0]


@query("SELECT '{\"k\": ' || o_orderkey AS value FROM orders WHERE o_orderkey % 7 = 0", "orders")
def source_jsonl_bad(orders):
    return _jsonl(orders)[1]


@query("SELECT n_nationkey AS k, n_name AS name FROM nation", "nation")
def source_json_path(nation):
    at = f"{scratch(nation.sparkSession)}/t"
    nation.select(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).alias("r")).agg(F.to_json(F.struct(F.struct(F.collect_list("r").alias("rows")).alias("data"))).alias("value")).coalesce(1).write.text(at)
    return readers.json_document(nation.sparkSession, at, "/data/rows").select(F.col("k").cast("int").alias("k"), "name")


@query("SELECT c_custkey, c_name AS \"/who/name\", c_nationkey AS \"/who/at/nation\" FROM customer", "customer")
def source_flatten(customer):
    at = f"{scratch(customer.sparkSession)}/t"
    _nested(customer).write.json(at)
    flat = readers.flatten(customer.sparkSession.read.schema(_nested(customer).schema).json(at))
    return flat.drop("parts")


@query("SELECT c_custkey, CAST(i - 1 AS INTEGER) AS parts_index, p[i] AS parts FROM (SELECT c_custkey, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT c_custkey, string_split(c_mktsegment, 'I') AS p FROM customer))", "customer")
def source_expand_lists(customer):
    return readers.expand_lists(_nested(customer).select("c_custkey", "parts"), ["parts"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", "orders")
def source_orc(orders):
    at = f"{scratch(orders.sparkSession)}/t"
    sinks.export(orders, at, "orc")
    return readers.columnar(orders.sparkSession, at).filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem", "lineitem")
def source_parquet_parts(lineitem):
    at = f"{scratch(lineitem.sparkSession)}/t"
    lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").write.partitionBy("l_returnflag").parquet(at)
    return readers.parquet_parts(lineitem.sparkSession, at).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT s_suppkey, s_name FROM supplier", "supplier")
def source_xml(supplier):
    at = f"{scratch(supplier.sparkSession)}/t"
    supplier.select("s_suppkey", "s_name").write.format("xml").option("rowTag", "row").option("rootTag", "rows").save(at)
    return readers.xml(supplier.sparkSession, at, "row").select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name")


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS key, lpad(CAST(s_nationkey AS VARCHAR), 4, ' ') AS nation FROM supplier", "supplier")
def source_fixed_width(supplier):
    at = f"{scratch(supplier.sparkSession)}/t"
    supplier.select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 12, "0"), F.lpad(F.col("s_nationkey").cast("string"), 4, " ")).alias("value")).write.text(at)
    return readers.fixed_width(supplier.sparkSession, at, {"key": (0, 12), "nation": (12, 4)})


def _rows(df: DataFrame) -> list[tuple]:
    """A small dimension table for a database file."""
    return [tuple(r) for r in df.collect()]


@query("SELECT n_nationkey - 5 AS k, n_name AS name FROM nation WHERE n_nationkey <> 7", "nation")
def source_sqlite(nation):
    import sqlite3

    at = f"{_local(scratch(nation.sparkSession))}/t.db"
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, name TEXT, unused TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, 'x')", _rows(nation.select(F.col("n_nationkey") - 5, "n_name")))
    return readers.sqlite(nation.sparkSession, at, "t", ["k", "name"], "k <> 2").select(F.col("k").cast("int").alias("k"), "name")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3", "nation")
def source_duckdb(nation):
    import duckdb

    at = f"{_local(scratch(nation.sparkSession))}/t.duckdb"
    with duckdb.connect(at) as db:
        db.execute("CREATE TABLE t (k INTEGER, name VARCHAR, region INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", _rows(nation.select("n_nationkey", "n_name", "n_regionkey")))
    return readers.duckdb_table(nation.sparkSession, at, "t", ["k", "name"], "region < 3")


@query("SELECT CAST(count(*) AS BIGINT) AS n, true AS same FROM orders", "orders")
def sink_publish(orders):
    back = sinks.publish(orders, scratch(orders.sparkSession), "v1")
    return back.agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.lit(sinks.fingerprint(back) == sinks.fingerprint(orders)))


# --- sets


def _keys(customer, orders):
    return customer.select(F.col("c_custkey").alias("k")), orders.select(F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END").alias("k"))


_SETS = "(SELECT c_custkey AS k FROM customer) {how} (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)"
for _how in ("union", "intersect", "except"):
    for _all in (False, True):

        def _set(customer, orders, how=_how, repeats=_all):
            return sets.combine(*_keys(customer, orders), how, repeats)

        _set.__name__ = f"set_{_how}" + "_all" * _all
        query(_SETS.format(how=_how.upper() + " ALL" * _all), "customer", "orders")(_set)


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 11 <> 0),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END) END AS columns
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p""",
    "orders",
)
def semantic_diff(orders):
    rows = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    after = rows.filter("k % 13 <> 0").select("k", F.expr("CASE WHEN k % 7 = 0 THEN NULL ELSE s END").alias("s"), F.expr("CASE WHEN k % 5 = 0 THEN p + 1 ELSE p END").alias("p"))
    return sets.difference(rows.filter("k % 11 <> 0"), after, ["k"])


@query(
    """SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""",
    "events",
)
def as_of_join(events_):
    bought = events_.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seen = events_.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return sets.as_of(bought, seen, ["user_id"], "ts", ["view_id"]).select("event_id", "view_id")


@query(
    """WITH v AS (SELECT 'cheap' AS rule, o_orderkey AS key FROM orders WHERE NOT o_totalprice < 300000 UNION ALL SELECT 'known', o_orderkey FROM orders WHERE NOT o_orderstatus IN ('F', 'O'))
    SELECT rule, key, violations FROM (SELECT rule, key, count(*) OVER (PARTITION BY rule) AS violations, row_number() OVER (PARTITION BY rule ORDER BY key) AS k FROM v) WHERE k <= 5""",
    "orders",
)
def violation_examples(orders):
    return sets.violations(orders, {"cheap": "o_totalprice < 300000", "known": "o_orderstatus IN ('F', 'O')"}, "o_orderkey")


@query(
    """SELECT * FROM (SELECT 'c_custkey' AS "column", 'identifier' AS role, count(DISTINCT c_custkey) AS "distinct" FROM customer UNION ALL SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) <= 20 THEN 'category' ELSE 'measure' END, count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'category', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_acctbal', 'measure', count(DISTINCT c_acctbal) FROM customer)""",
    "customer",
)
def role_suggestion(customer):
    return sets.roles(customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))


@query(
    """WITH o AS (SELECT o_custkey AS g, o_totalprice AS v, o_orderkey AS k FROM orders), c AS (SELECT g, v, count(*) AS n FROM o GROUP BY 1, 2),
    r AS (SELECT g, v, sum(n) OVER (PARTITION BY g ORDER BY v) - (n - 1) / 2.0 AS r FROM c) SELECT k, CAST(r AS DOUBLE) AS rank FROM o JOIN r USING (g, v)""",
    "orders",
)
def rank_in_groups(orders):
    rows = orders.select(F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    return windows.average_rank(rows, "v", "rank", ["g"]).select("k", F.col("rank").cast("double").alias("rank"))


@query("SELECT s_acctbal AS value, round((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 0.5) / count(*) OVER (), 9) AS p FROM supplier", "supplier")
def chart_qq(supplier):
    return charts.qq(supplier, "s_acctbal", "s_suppkey").select("value", F.round("p", 9).alias("p"))


# --- reports


@query("SELECT c_name, c_custkey FROM customer", "customer")
def select_columns(customer):
    return project.select(customer, ["c_name", "c_custkey"])


@query(
    """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS s, o_custkey AS c FROM orders), b AS (SELECT k, coalesce(s, 'X') AS s, c FROM a WHERE k % 10 <> 0)
    SELECT 's' AS "column", count(*) FILTER (a.s IS NULL) AS nulls_before, count(*) FILTER (b.k IS NOT NULL AND b.s IS NULL) AS nulls_after, count(*) FILTER (b.k IS NOT NULL AND a.s IS DISTINCT FROM b.s) AS changed, count(*) FILTER (b.k IS NULL) AS removed FROM a LEFT JOIN b USING (k)
    UNION ALL SELECT 'c', count(*) FILTER (a.c IS NULL), count(*) FILTER (b.k IS NOT NULL AND b.c IS NULL), count(*) FILTER (b.k IS NOT NULL AND a.c IS DISTINCT FROM b.c), count(*) FILTER (b.k IS NULL) FROM a LEFT JOIN b USING (k)""",
    "orders",
)
def impact_report(orders):
    before = orders.select(F.col("o_orderkey").alias("k"), F.expr("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END").alias("s"), F.col("o_custkey").alias("c"))
    return cleaning.impact(before, before.filter("k % 10 <> 0").fillna({"s": "X"}), "k")


@query(
    """SELECT l_linenumber AS chunk, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem GROUP BY 1
    UNION ALL SELECT NULL, count(*), sum(l_quantity), min(l_quantity), max(l_quantity) FROM lineitem""",
    "lineitem",
)
def chunk_summary(lineitem):
    return profile.chunk_summary(lineitem.withColumn("l_quantity", F.col("l_quantity").cast("double")), "l_linenumber", "l_quantity")


@query("SELECT 'o_custkey' AS \"column\", count(*) FILTER (o_custkey IS NULL) AS missing, min(o_custkey) = max(o_custkey) AS constant, false AS copies_target FROM orders UNION ALL SELECT 'one', 0, true, false UNION ALL SELECT 'leak', 0, false, true", "orders")
def suitability_scan(orders):
    return profile.suitability(orders.select("o_custkey", F.lit(1).alias("one"), F.col("o_orderstatus").alias("leak"), "o_orderstatus"), "o_orderstatus")


@query(
    """WITH d AS (SELECT event_id AS o, value - avg(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 0.1 AS d FROM events), m AS (SELECT o, sum(d) OVER (ORDER BY o) AS m FROM d)
    SELECT o AS "order", round(m - least(0, min(m) OVER (ORDER BY o)), 2) AS statistic FROM m""",
    "events",
)
def drift_alarm(events_):
    return monitor.page_hinkley(events_, "event_id", "value", 0.1, 50.0).select("order", F.round("statistic", 2).alias("statistic"))


@query(
    """WITH c AS (SELECT l_linenumber AS source, l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT source, min(o) AS first, max(o) AS last, CAST(sum(n) AS BIGINT) AS rows, max(o) - min(o) + 1 - count(*) AS missing, CAST(sum(n) - count(*) AS BIGINT) AS repeated FROM c GROUP BY 1""",
    "lineitem",
)
def stream_cursor(lineitem):
    return streams.cursor_check(lineitem, "l_linenumber", "l_orderkey")


# The ratio has no SQL; tests hold it against brute force.
@query(None, "supplier")
def block_pairs_ratio(supplier):
    return relational.block_pairs(supplier, "s_suppkey", ["s_nationkey"], "s_name", 0.9, "ratio")

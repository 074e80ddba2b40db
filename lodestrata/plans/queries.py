"""Registered queries for the operators, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import exact_cast, fold
from ..operators import charts, cleaning, events, geo, graph, ml, monitor, privacy, profile, project, quality, relational, stats, text, timeseries, windows
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None, *tables: str):
    """Registers a function of the named tables under its own name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name!r} is taken")
        QUERIES[name] = lambda spark, sf_dir: f(*[_table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _bigint(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


# --- grouping and reshaping


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS price,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS quantity, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-12-31' GROUP BY 1, 2""",
    "lineitem",
)
def agg_basic(lineitem):
    rows = project.where(lineitem, ("l_shipdate", "le", "2001-12-31 00:00:00"))
    rows = rows.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("l_extendedprice", "l_quantity")})
    return relational.aggregate(
        rows, ["l_returnflag", "l_linestatus"],
        {"n": ("count",), "price": ("sum", "l_extendedprice", "decimal(38,2)"), "quantity": ("sum", "l_quantity", "decimal(38,2)"), "first_ship": ("min", "l_shipdate"), "last_ship": ("max", "l_shipdate")},
    )


@query("SELECT count(*) AS n, sum(l_tax) AS tax, min(l_tax) AS low FROM lineitem WHERE l_quantity < 0", "lineitem")
def agg_global_empty(lineitem):
    return relational.aggregate(project.where(lineitem, ("l_quantity", "lt", 0)), [], {"n": ("count",), "tax": ("sum", "l_tax"), "low": ("min", "l_tax")})


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, count(*) AS n, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS big FROM orders GROUP BY 1", "orders")
def agg_null_group(orders):
    rows = orders.select(F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.when(F.col("o_totalprice") > 100000, 1).alias("b"))
    return relational.aggregate(rows, ["status"], {"n": ("count",), "big": ("count_valid", "b")})


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"Pivot_F\", count(*) FILTER (l_linestatus = 'O') AS \"Pivot_O\" FROM lineitem GROUP BY 1", "lineitem")
def pivot_count(lineitem):
    return relational.pivot(lineitem, ["l_returnflag"], "l_linestatus", ["F", "O"], "count")


@query(
    """SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DECIMAL(38,2)) AS "Pivot_F",
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DECIMAL(38,2)) AS "Pivot_O",
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DECIMAL(38,2)) AS "Pivot_P" FROM orders GROUP BY 1""",
    "orders",
)
def pivot_sum(orders):
    rows = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return relational.pivot(rows, ["o_orderpriority"], "o_orderstatus", sorted(relational.header_values(rows, "o_orderstatus", "o_orderkey")), "sum", "o_totalprice", "decimal(38,2)")


@query("SELECT p_partkey, 'size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part", "part")
def unpivot(part):
    return relational.unpivot(part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"])


@query(
    "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name, s_acctbal, NULL FROM supplier",
    "customer", "supplier",
)
def append_pad(customer, supplier):
    c = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sid"), "s_name", "s_acctbal")
    return relational.append(c, s, {"sid": "id", "s_name": "name", "s_acctbal": "balance"})


# --- joins


def _sides(customer, orders):
    c = customer.select(F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END").alias("ck"), "c_name")
    o = orders.select(F.expr("CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE o_custkey END").alias("ok"), "o_orderkey")
    return c, o


_JOIN = """WITH c AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS ck, c_name FROM customer),
o AS (SELECT CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE o_custkey END AS ok, o_orderkey FROM orders)
SELECT ck, c_name, ok, o_orderkey FROM c {how} JOIN o ON {cond}"""

for _how in ("inner", "left", "right", "full"):
    for _null in (False, True):

        def _join(customer, orders, how=_how, null=_null):
            return relational.join(*_sides(customer, orders), [("ck", "ok")], how, null)

        _join.__name__ = f"join_{_how}" + ("_null_equal" if _null else "")
        query(_JOIN.format(how=_how.upper(), cond="ck IS NOT DISTINCT FROM ok" if _null else "ck = ok"), "customer", "orders")(_join)


@query(
    """WITH l AS (SELECT o_custkey AS k, count(*) AS lc FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS rc FROM customer GROUP BY 1),
    b AS (SELECT lc, rc FROM l FULL JOIN r ON l.k = r.k),
    s AS (SELECT coalesce(sum(lc * rc), 0) AS i, coalesce(sum(lc) FILTER (rc IS NULL), 0) AS lu, coalesce(sum(rc) FILTER (lc IS NULL), 0) AS ru, max(lc) FILTER (rc IS NOT NULL) AS ml, max(rc) FILTER (lc IS NOT NULL) AS mr FROM b)
    SELECT CAST(i AS BIGINT) AS inner_rows, CAST(lu AS BIGINT) AS left_unmatched, CAST(ru AS BIGINT) AS right_unmatched, CAST(i + lu AS BIGINT) AS left_rows, CAST(i + ru AS BIGINT) AS right_rows,
    CAST(i + lu + ru AS BIGINT) AS full_rows, CASE WHEN ml > 1 THEN 'n' ELSE '1' END || ':' || CASE WHEN mr > 1 THEN 'n' ELSE '1' END AS relationship FROM s""",
    "orders", "customer",
)
def join_preflight(orders, customer):
    return relational.preflight(orders, customer, [("o_custkey", "c_custkey")])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)", "lineitem", "part")
def anti_fk(lineitem, part):
    return relational.orphans(lineitem, part.filter("p_size > 5"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", "orders", "customer")
def semi_brush(orders, customer):
    return relational.semi(orders, customer.filter("c_mktsegment = 'MACHINERY'"), [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS edges, count(DISTINCT input_row_id) AS inputs FROM (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS input_row_id FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey)", "orders", "customer")
def join_lineage(orders, customer):
    joined = relational.join(orders.select(F.concat(F.lit("o"), "o_orderkey").alias("oid"), "o_custkey"), customer.select(F.concat(F.lit("c"), "c_custkey").alias("cid"), "c_custkey"), [("o_custkey", "c_custkey")])
    return relational.lineage(joined, "oid", "cid").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("input_row_id").alias("inputs"))


@query(
    """WITH t AS (SELECT p_partkey AS id, p_brand AS b, lower(trim(p_name || CAST(p_partkey % 10 AS VARCHAR))) AS t FROM part)
    SELECT x.id AS left_id, y.id AS right_id, 1 - levenshtein(x.t, y.t) / CAST(greatest(length(x.t), length(y.t)) AS DOUBLE) AS similarity FROM t x JOIN t y ON x.b = y.b AND x.id < y.id
    WHERE 1 - levenshtein(x.t, y.t) / CAST(greatest(length(x.t), length(y.t)) AS DOUBLE) >= 0.8""",
    "part",
)
def block_pairs(part):
    return relational.block_pairs(part.select("p_partkey", "p_brand", F.concat("p_name", (F.col("p_partkey") % 10).cast("string")).alias("t")), "p_partkey", ["p_brand"], "t", 0.8)


# --- filters, projections, formulas

_PREDICATES = {
    "filter_eq": (("l_linenumber", "eq", 3), "l_linenumber = 3"), "filter_ne": (("l_returnflag", "ne", "A"), "l_returnflag <> 'A'"),
    "filter_gt": (("l_quantity", "gt", 45), "l_quantity > 45"), "filter_ge": (("l_quantity", "ge", 45), "l_quantity >= 45"),
    "filter_lt": (("l_discount", "lt", "0.02"), "l_discount < 0.02"), "filter_le": (("l_shipdate", "le", "1996-01-01"), "l_shipdate <= TIMESTAMP '1996-01-01'"),
}
for _name, (_p, _sql) in _PREDICATES.items():

    def _filter(lineitem, p=_p):
        return project.where(lineitem, p).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")

    _filter.__name__ = _name
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE {_sql}", "lineitem")(_filter)


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') AND p_size > 10 AND p_brand IN ('Brand#2', 'Brand#17')", "part")
def filter_contains_and(part):
    return project.within(project.where(part, ("p_name", "contains", "ring"), ("p_size", "gt", 10)), "p_brand", ["Brand#2", "Brand#17"]).select("p_partkey", "p_name")


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM events) WHERE v > 20 AND isfinite(v)", "events")
def filter_finite(events_):
    v = F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN double('NaN') WHEN event_id % 11 = 0 THEN double('Infinity') ELSE value END")
    return project.where(events_.select("event_id", v.alias("v")), ("v", "gt", 20))


@query("SELECT count(*) AS rows, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (isnan(v)) AS nans FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS v FROM events)", "events")
def filter_null_nan(events_):
    v = events_.select(F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN double('NaN') ELSE value END").alias("v"))
    a, b = project.where(v, ("v", "is_null")), project.where(v, ("v", "is_nan"))
    return v.agg(F.count(F.lit(1)).alias("rows")).join(a.agg(F.count(F.lit(1)).alias("nulls"))).join(b.agg(F.count(F.lit(1)).alias("nans")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 0) AS net, l_quantity / nullif(l_tax, 0) AS ratio FROM lineitem", "lineitem")
def computed_net(lineitem):
    rows = project.computed(lineitem, "net", 'round(col("l_quantity") / 4, 0)')
    return project.computed(rows, "ratio", 'col("l_quantity") / col("l_tax")', "null").select("l_orderkey", "l_linenumber", "l_partkey", "net", "ratio")


@query("SELECT o_orderkey, CASE WHEN s IS NULL THEN NULL WHEN s = 'F' THEN 1 ELSE 2 END AS flag, (s = 'F' OR o_totalprice > 100000) AS either, coalesce(upper(s), '?') AS shown FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders)", "orders")
def computed_unknown(orders):
    rows = orders.withColumn("s", F.expr("nullif(o_orderstatus, 'P')"))
    rows = project.computed(rows, "flag", 'ifelse(col("s") == "F", 1, 2)')
    rows = project.computed(rows, "either", 'col("s") == "F" or col("o_totalprice") > 100000')
    return project.computed(rows, "shown", 'coalesce(upper(col("s")), "?")').select("o_orderkey", "flag", "either", "shown")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS a, nullif(split_part(p_name, ' ', 2), '') AS b FROM part", "part")
def text_split(part):
    return project.text_split(part, "p_name", " ", ["a", "b"]).select("p_partkey", "a", "b")


@query("SELECT o_orderkey, CASE WHEN s IS NULL THEN NULL ELSE s || '-' || o_orderpriority END AS whole, concat_ws('-', s, o_orderpriority) AS skipped FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders)", "orders")
def text_combine(orders):
    rows = orders.withColumn("s", F.expr("nullif(o_orderstatus, 'P')"))
    rows = project.text_combine(rows, ["s", "o_orderpriority"], "-", "whole")
    return project.text_combine(rows, ["s", "o_orderpriority"], "-", "skipped", "skip").select("o_orderkey", "whole", "skipped")


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) AS INTEGER) AS ts_weekday, CAST(week(ts) AS INTEGER) AS ts_week, CAST(quarter(ts) AS INTEGER) AS ts_quarter, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute FROM events", "events")
def date_parts(events_):
    parts = ("year", "month", "day", "weekday", "week", "quarter", "hour", "minute")
    return project.date_parts(events_, "ts", parts).select("event_id", *[f"ts_{p}" for p in parts])


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority), o_orderkey LIMIT 200 OFFSET 200", "orders")
def sort_page(orders):
    ranked = project.sort(orders, "o_orderpriority", "o_orderkey", order=["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return project.page(ranked, 1).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) WHEN p_partkey % 3 = 1 THEN NULL ELSE 7 END AS n FROM part", "part")
def exact_cast_text(part):
    raw = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_size) WHEN p_partkey % 3 = 1 THEN '1.5' ELSE '7' END")
    rows = part.select("p_partkey", raw.alias("t"))
    return rows.select("p_partkey", exact_cast(F.col("t"), rows.schema["t"].dataType, "bigint").alias("n"))


# --- cleaning

_HOLES = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events)"


def _holes(events_):
    return events_.select("event_id", "user_id", "event_type", F.expr("CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END").alias("v"))


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {_HOLES}", "events")
def ordered_fill_forward(events_):
    return cleaning.ordered_fill(_holes(events_), "v", ["user_id"], ["event_id"], "event_id").select("event_id", "v")


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS v FROM {_HOLES}", "events")
def ordered_fill_backward(events_):
    return cleaning.ordered_fill(_holes(events_), "v", ["user_id"], ["event_id"], "event_id", "backward").select("event_id", "v")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS r FROM events) WHERE r = 1", "events")
def dedup_first(events_):
    return cleaning.dedup(events_, ["user_id", "event_type"], ["value"], "event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE r = 1", "events")
def dedup_last(events_):
    return cleaning.dedup(events_, ["user_id", "event_type"], ["value"], "event_id", keep="last").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id) AS r FROM events) WHERE r = 1", "events")
def dedup_descending(events_):
    return cleaning.dedup(events_, ["user_id"], ["event_type"], "event_id", descending=True).select("event_id", "user_id")


@query(f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_HOLES})), 6) AS v FROM {_HOLES}", "events")
def fill_mean(events_):
    return cleaning.fill_statistic(_holes(events_), "v", "mean").select("event_id", F.round("v", 6).alias("v"))


@query(f"SELECT event_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM {_HOLES})) AS v FROM {_HOLES}", "events")
def fill_median(events_):
    return cleaning.fill_statistic(_holes(events_), "v", "median").select("event_id", "v")


@query("SELECT event_id, coalesce(t, (SELECT t FROM (SELECT CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 < 3 THEN 'view' ELSE event_type END AS t FROM events) WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC LIMIT 1)) AS t FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 < 3 THEN 'view' ELSE event_type END AS t FROM events)", "events")
def fill_mode(events_):
    return cleaning.fill_mode(events_.select("event_id", F.expr("CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 < 3 THEN 'view' ELSE event_type END").alias("t")), "t")


@query(f"SELECT event_id, coalesce(v, -1) AS v FROM {_HOLES}", "events")
def fill_constant(events_):
    return cleaning.fill_constant(_holes(events_), "v", -1).select("event_id", "v")


@query(f"SELECT event_id, v FROM {_HOLES} WHERE v IS NOT NULL", "events")
def missing_rows(events_):
    return cleaning.drop_missing_rows(_holes(events_), ["v", "event_id"]).select("event_id", "v")


@query("SELECT event_id, user_id FROM events", "events")
def missing_columns(events_):
    return cleaning.drop_missing_columns(events_.select("event_id", "user_id", F.lit(None).cast("string").alias("none")), ["user_id", "none"])


@query("SELECT event_id, value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outlier FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)", "events")
def outlier_iqr(events_):
    return cleaning.outliers_iqr(events_, "value").select("event_id", "value", "outlier")


@query(
    """WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS m, avg(value) AS mean, stddev_pop(value) AS sd FROM events),
    d AS (SELECT quantile_cont(abs(value - m), 0.5) AS mad FROM events, s),
    f AS (SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS by_iqr, 0.6745 * abs(value - m) / mad > 3.5 AS by_robust_z, abs(value - mean) / sd > 3 AS by_z FROM events, s, d)
    SELECT * FROM f WHERE by_iqr OR by_robust_z OR by_z""",
    "events",
)
def outlier_three_methods(events_):
    return cleaning.outlier_candidates(events_, "value").select("event_id", "by_iqr", "by_robust_z", "by_z")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders", "orders")
def map_categories(orders):
    return cleaning.map_categories(orders, "o_orderstatus", {"F": "final", "O": "open"}).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, trim(p_name) AS p_name, lower(replace(trim(p_type), 'I', 'ı')) AS folded FROM part", "part")
def trim_fold(part):
    rows = part.withColumn("p_name", F.concat(F.lit(" \t"), "p_name", F.lit("  ")))
    return cleaning.trim(rows, "p_name").select("p_partkey", "p_name", fold(F.col("p_type")).alias("folded"))


@query(f"SELECT count(*) FILTER (v IS NULL) AS rows_lost, round(avg(event_id), 6) AS mean_before, round(avg(event_id) FILTER (v IS NOT NULL), 6) AS mean_after, quantile_cont(CAST(event_id AS DOUBLE), 0.5) AS median_before, quantile_cont(CAST(event_id AS DOUBLE), 0.5) FILTER (v IS NOT NULL) AS median_after FROM {_HOLES}", "events")
def drop_impact(events_):
    return cleaning.drop_impact(_holes(events_), "v", "event_id").withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


# --- profiles and quality


@query(
    """SELECT count(*) AS rows, count(*) FILTER (l_quantity IS NULL) AS nulls, 0::BIGINT AS nans, 0::BIGINT AS plus_inf, 0::BIGINT AS minus_inf, count(l_quantity) AS valid, count(DISTINCT l_quantity) AS distinct, min(l_quantity) AS min, max(l_quantity) AS max,
    round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, quantile_cont(l_quantity, 0.05) AS q05, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, quantile_cont(l_quantity, 0.95) AS q95 FROM lineitem""",
    "lineitem",
)
def profile_numeric(lineitem):
    return profile.profile(lineitem, "l_quantity").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT count(*) AS rows, 0::BIGINT AS nulls, 0::BIGINT AS empty, count(*) AS valid, count(DISTINCT event_type) AS distinct, min(event_type) AS min, max(event_type) AS max FROM events", "events")
def profile_text(events_):
    return profile.profile(events_, "event_type")


@query("SELECT 'c_custkey' AS \"column\", 'bigint' AS type, count(c_custkey) AS non_null, 0::BIGINT AS nulls, 0::BIGINT AS nans FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal), 0, 0 FROM customer", "customer")
def inventory(customer):
    return profile.inventory(customer.select("c_custkey", "c_acctbal"))


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 20", "events")
def top_values(events_):
    return windows.top_values(events_, "event_type", "event_id")


@query(
    """WITH b AS (SELECT value FROM events WHERE event_id % 2 = 0), a AS (SELECT value FROM events WHERE event_id % 2 = 1)
    SELECT 'value' AS "column", (SELECT count(*) FROM b) AS rows_before, 0::BIGINT AS missing_before, (SELECT count(DISTINCT value) FROM b) AS distinct_before, (SELECT round(quantile_cont(value, 0.25), 9) FROM b) AS q25_before, (SELECT round(quantile_cont(value, 0.5), 9) FROM b) AS q50_before, (SELECT round(quantile_cont(value, 0.75), 9) FROM b) AS q75_before,
    (SELECT count(*) FROM a) AS rows_after, 0::BIGINT AS missing_after, (SELECT count(DISTINCT value) FROM a) AS distinct_after, (SELECT round(quantile_cont(value, 0.25), 9) FROM a) AS q25_after, (SELECT round(quantile_cont(value, 0.5), 9) FROM a) AS q50_after, (SELECT round(quantile_cont(value, 0.75), 9) FROM a) AS q75_after""",
    "events",
)
def compare_snapshots(events_):
    return profile.compare(events_.filter("event_id % 2 = 0"), events_.filter("event_id % 2 = 1"), ["value"]).withColumns({f"q{q}_{x}": F.round(f"q{q}_{x}", 9) for q in (25, 50, 75) for x in ("before", "after")})


@query("SELECT round(sum(o_totalprice), 2) AS numerator, CAST(count(*) AS DOUBLE) AS denominator, round(sum(o_totalprice) / count(*), 6) AS value FROM orders", "orders")
def kpi(orders):
    return profile.kpi(orders, "sum", "o_totalprice", "rows").select(F.round("numerator", 2).alias("numerator"), "denominator", F.round("value", 6).alias("value"))


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS weighted_mean FROM lineitem", "lineitem")
def weighted_mean(lineitem):
    return profile.weighted_mean(lineitem, "l_discount", "l_quantity").select(F.round("weighted_mean", 9).alias("weighted_mean"))


@query(
    """WITH m AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem), z AS (SELECT l_returnflag AS h, l_suppkey AS u, sum(l_quantity * (l_discount - m) / w) AS z FROM lineitem, m GROUP BY 1, 2),
    s AS (SELECT h, count(*) AS n, var_samp(z) * count(*) AS v FROM z GROUP BY 1 HAVING count(*) >= 2)
    SELECT round((SELECT m FROM m), 9) AS mean, round(sqrt(sum(v)), 9) AS se FROM s""",
    "lineitem",
)
def survey_mean(lineitem):
    return profile.survey_mean(lineitem, "l_discount", "l_quantity", "l_returnflag", "l_suppkey").select(F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem", "lineitem")
def chart_corr(lineitem):
    return profile.correlation(lineitem, ["l_quantity", "l_extendedprice"]).filter("a <> b").withColumn("r", F.round("r", 9))


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS y FROM lineitem)
    SELECT 'l_quantity' AS a, 'l_discount' AS b, count(*) AS n, round(corr(x, y), 9) AS r FROM r""",
    "lineitem",
)
def spearman(lineitem):
    return profile.correlation(lineitem, ["l_quantity", "l_discount"], "spearman").withColumn("r", F.round("r", 9))


@query("SELECT o_orderkey, o_custkey, group_rows FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS group_rows FROM orders) WHERE group_rows > 1", "orders")
def quality_duplicates(orders):
    return quality.duplicates(orders, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey", "group_rows")


@query(
    """SELECT 'range' AS rule, 'range' AS kind, 'row' AS scope, 'error' AS severity, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) AS violations FROM orders
    UNION ALL SELECT 'allowed', 'allowed', 'row', 'warning', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
    UNION ALL SELECT 'unique', 'unique', 'column', 'error', CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS BIGINT)
    UNION ALL SELECT 'fk', 'foreign_key', 'cross_table', 'error', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0))""",
    "orders", "customer",
)
def contract_rules(orders, customer):
    return quality.evaluate(orders, [
        {"name": "range", "kind": "range", "column": "o_totalprice", "min": 1000, "max": 400000},
        {"name": "allowed", "kind": "allowed", "column": "o_orderstatus", "values": ["F", "O"], "severity": "warning"},
        {"name": "unique", "kind": "unique", "column": "o_custkey"},
        {"name": "fk", "kind": "foreign_key", "column": "o_custkey", "reference": "c", "key": "c_custkey"},
    ], {"c": customer.filter("c_custkey % 10 <> 0")})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 400000", "orders")
def quarantine(orders):
    return quality.quarantine(orders, [{"kind": "range", "column": "o_totalprice", "min": 1000, "max": 400000}])[1].select("o_orderkey", "o_totalprice")


@query("SELECT 'lang' AS \"column\", count(*) FILTER (lang IS NULL) AS missing, 0::BIGINT AS nonfinite, 0::BIGINT AS whitespace, min(lang) = max(lang) AS constant FROM documents", "documents")
def quality_scan(documents):
    return quality.scan(documents.select("lang"))


# --- charts


@query("SELECT CAST(b AS INTEGER) AS bin, lo + b * w AS low, lo + (b + 1) * w AS high, count(*) AS n FROM (SELECT least(9, floor((l_quantity - lo) / w)) AS b, lo, w FROM lineitem, (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem)) GROUP BY b, lo, w", "lineitem")
def chart_hist(lineitem):
    return charts.histogram(lineitem, "l_quantity", 10)


@query(
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(l_extendedprice) FILTER (inside) AS whisker_low, max(l_extendedprice) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS fliers, count(*) AS n
    FROM (SELECT q.*, l_extendedprice, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM lineitem JOIN q USING (l_returnflag)) GROUP BY ALL""",
    "lineitem",
)
def chart_box(lineitem):
    return charts.box(lineitem, "l_extendedprice", ["l_returnflag"]).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("SELECT CASE WHEN r <= 2 THEN value ELSE 'other' END AS value, CAST(sum(count) AS BIGINT) AS count FROM (SELECT value, count, row_number() OVER (ORDER BY count DESC, f) AS r FROM (SELECT event_type AS value, count(*) AS count, min(event_id) AS f FROM events GROUP BY 1)) GROUP BY 1", "events")
def chart_topn_other(events_):
    return windows.top_and_other(events_, "event_type", "event_id", 2)


@query("SELECT l_quantity AS value, round(sum(count(*)) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem), 12) AS cumulative FROM lineitem GROUP BY 1", "lineitem")
def chart_ecdf(lineitem):
    return windows.ecdf(lineitem, "l_quantity").withColumn("cumulative", F.round("cumulative", 12))


@query("SELECT category, amount, round(100 * sum(amount) OVER (ORDER BY amount DESC, category ROWS UNBOUNDED PRECEDING) / sum(amount) OVER (), 9) AS cumulative_percent FROM (SELECT event_type AS category, CAST(count(*) AS DOUBLE) AS amount FROM events GROUP BY 1)", "events")
def chart_pareto(events_):
    return windows.pareto(events_, "event_type").withColumn("cumulative_percent", F.round("cumulative_percent", 9))


@query("SELECT x, series, amount, round(100 * amount / sum(amount) OVER (PARTITION BY x), 9) AS percent, sum(amount) OVER (PARTITION BY x ORDER BY series ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT l_returnflag AS x, l_linestatus AS series, CAST(sum(l_quantity) AS DOUBLE) AS amount FROM lineitem GROUP BY 1, 2)", "lineitem")
def chart_percent(lineitem):
    return windows.shares(lineitem, "l_returnflag", "l_linestatus", "l_quantity").select("x", "series", "amount", F.round("percent", 9).alias("percent"), "top")


@query("SELECT CAST(o_orderdate AS DATE) AS day, CAST(floor(date_diff('day', DATE_TRUNC('week', DATE '1997-01-01'), CAST(o_orderdate AS DATE)) / 7) AS INTEGER) AS week, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, count(*) AS value FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2, 3", "orders")
def chart_calendar(orders):
    return charts.calendar(orders, "o_orderdate", 1997)


@query("SELECT CAST(least(19, floor((l_quantity - x0) / ((x1 - x0) / 20))) AS INTEGER) AS ix, CAST(least(19, floor((l_extendedprice - y0) / ((y1 - y0) / 20))) AS INTEGER) AS iy, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) GROUP BY 1, 2", "lineitem")
def chart_grid(lineitem):
    return charts.grid(lineitem, "l_quantity", "l_extendedprice", 20)


@query("SELECT l_returnflag AS category, count(*) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS half FROM lineitem GROUP BY 1", "lineitem")
def chart_error_bar(lineitem):
    return charts.error_bars(lineitem, "l_returnflag", "l_quantity").select("category", "n", F.round("mean", 9).alias("mean"), F.round("half", 9).alias("half"))


@query("SELECT c_mktsegment AS category, quantile_cont(c_acctbal, 0.5) AS value FROM customer GROUP BY 1", "customer")
def chart_bar_median(customer):
    return charts.bar(customer, "c_mktsegment", "median", "c_acctbal")


@query("SELECT CAST(v IS NULL AS INTEGER)::VARCHAR || CAST(user_id IS NULL AS INTEGER)::VARCHAR AS pattern, count(*) AS rows FROM (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1", "events")
def chart_missing_pattern(events_):
    return charts.missing_patterns(_holes(events_), ["v", "user_id"])


@query("SELECT CAST(n_name AS VARCHAR) AS region, count(*) AS value, CAST((count(*) >= 10) AS INTEGER) + CAST((count(*) >= 60) AS INTEGER) AS class FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "customer", "nation")
def chart_choropleth(customer, nation):
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.lit(1).alias("one"))
    return charts.choropleth(rows, "n_name", "one", [10, 60])


@query(
    """WITH leaf AS (SELECT r_name AS a, n_name AS b, CAST(count(*) AS DOUBLE) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
    SELECT 'all' AS node, 0 AS depth, sum(v) AS total FROM leaf UNION ALL SELECT a, 1, sum(v) FROM leaf GROUP BY a UNION ALL SELECT b, 2, v FROM leaf""",
    "region", "nation", "customer",
)
def tree_rollup(region, nation, customer):
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = joined.groupBy(F.col("n_name").alias("node"), F.col("r_name").alias("parent")).agg(F.count(F.lit(1)).cast("double").alias("amount"))
    inner = leaves.select(F.col("parent").alias("node"), F.lit("all").alias("parent"), F.lit(0.0).alias("amount")).distinct()
    root = customer.sparkSession.range(1).select(F.lit("all").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("amount"))
    return charts.tree(leaves.unionByName(inner).unionByName(root), "node", "parent", "amount")


# --- events and streams


@query("WITH f AS (SELECT user_id, date_trunc('week', min(ts)) AS cohort FROM events GROUP BY 1) SELECT CAST(cohort AS DATE) AS cohort, CAST(date_diff('day', cohort, date_trunc('week', ts)) / 7 AS INTEGER) AS \"offset\", count(DISTINCT user_id) AS entities FROM events JOIN f USING (user_id) GROUP BY 1, 2", "events")
def cohort_retention(events_):
    return events.cohort(events_, "user_id", "ts", "week").withColumn("cohort", F.to_date("cohort"))


@query(
    """WITH a AS (SELECT user_id, min(epoch(ts)) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1),
    b AS (SELECT a.user_id, t0, min(epoch(ts)) AS t1 FROM a JOIN events e ON e.user_id = a.user_id AND event_type = 'click' AND epoch(ts) > t0 AND epoch(ts) < t0 + 864000 GROUP BY 1, 2),
    c AS (SELECT b.user_id, min(epoch(ts)) AS t2 FROM b JOIN events e ON e.user_id = b.user_id AND event_type = 'purchase' AND epoch(ts) > t1 AND epoch(ts) < t0 + 864000 GROUP BY 1)
    SELECT 0 AS stage, 'view' AS activity, (SELECT count(*) FROM a) AS entities UNION ALL SELECT 1, 'click', (SELECT count(*) FROM b) UNION ALL SELECT 2, 'purchase', (SELECT count(*) FROM c)""",
    "events",
)
def funnel(events_):
    return events.funnel(events_, "user_id", "event_type", "ts", ["view", "click", "purchase"], 864000)


@query("SELECT source, target, count(*) AS n FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY 1, 2", "events")
def dfg_edges(events_):
    return events.follows(events_, "user_id", "event_type", ["ts", "event_id"])


@query("WITH e AS (SELECT arg_min(event_type, event_id) AS s, arg_max(event_type, event_id) AS e FROM events GROUP BY user_id) SELECT activity, CAST(sum(starts) AS BIGINT) AS starts, CAST(sum(ends) AS BIGINT) AS ends FROM (SELECT s AS activity, 1 AS starts, 0 AS ends FROM e UNION ALL SELECT e, 0, 1 FROM e) GROUP BY 1", "events")
def case_ends(events_):
    return events.case_ends(events_, "user_id", "event_type", ["event_id"])


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS t, l_suppkey % 10 AS i FROM lineitem), n AS (SELECT count(DISTINCT t) AS n FROM p)
    SELECT CAST(i AS VARCHAR) AS items, count(*) AS n FROM p, n GROUP BY i, n.n HAVING count(*) >= 0.05 * n.n
    UNION ALL SELECT CAST(a.i AS VARCHAR) || ',' || CAST(b.i AS VARCHAR), count(*) FROM p a JOIN p b ON a.t = b.t AND a.i < b.i, n GROUP BY a.i, b.i, n.n HAVING count(*) >= 0.05 * n.n""",
    "lineitem",
)
def frequent_sets(lineitem):
    rows = lineitem.select(F.col("l_orderkey").alias("t"), (F.col("l_suppkey") % 10).cast("string").alias("i"))
    return events.frequent_sets(rows, "t", "i", 0.05, 2).select(F.array_join("items", ",").alias("items"), "n")


_ARRIVAL = "(SELECT *, row_number() OVER (ORDER BY user_id, event_id) AS arrival FROM events)"


def _arrival(events_):
    from pyspark.sql import Window

    return events_.withColumn("arrival", F.row_number().over(Window.orderBy("user_id", "event_id")))


@query(f"SELECT event_id, coalesce(ts < max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 DAY, false) AS late FROM {_ARRIVAL}", "events")
def stream_watermark_late(events_):
    return streams.with_watermark_twin(_arrival(events_), "ts", "arrival", "5 days").select("event_id", "late")


@query(
    f"""WITH a AS (SELECT ts, coalesce(ts < max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 25 DAY, false) AS late FROM {_ARRIVAL})
    SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 25 DAY FROM a) AS closed FROM a WHERE NOT late GROUP BY ALL""",
    "events",
)
def stream_tumbling_closed(events_):
    return streams.tumbling_twin(_arrival(events_), "ts", "arrival", "1 day", "25 days").select(F.to_date("window_start").alias("day"), "n", "closed")


# --- text


@query("SELECT term, CAST(sum(tf) AS BIGINT) AS count, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", "documents")
def token_df(documents):
    return text.vocabulary(text.term_counts(documents, "doc_id", "text"), 100)


@query(
    """WITH t AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}]+')) AS term FROM documents) GROUP BY 1, 2),
    v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 50),
    w AS (SELECT doc, term, tf * idf AS w FROM t JOIN v USING (term)) SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 9) AS weight FROM w""",
    "documents",
)
def tfidf_terms(documents):
    return text.tfidf(documents, "doc_id", "text", 50).withColumn("weight", F.round("weight", 9))


@query("SELECT 'text' AS \"column\", count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails, count(*) FILTER (regexp_matches(text, '(^|[^\\p{L}\\p{N}_-])\\+?[0-9][0-9 ()]{8,}[0-9]([^\\p{L}\\p{N}_-]|$)')) AS phones, count(*) FILTER (regexp_matches(text, '(?i)(password|secret|token|api_key)\\s*[=:]')) AS secrets, false AS name_hint FROM documents", "documents")
def pii_scan(documents):
    return privacy.scan(documents.select("text"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS cosine FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20", "embeddings")
def topk_embeddings_cosine(embeddings):
    q = embeddings.filter("vec_id = 0").first().embedding
    return text.search(embeddings, "vec_id", "embedding", q, 20).withColumn("cosine", F.round("cosine", 9))


# --- statistics, series, monitoring


@query("SELECT round(avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'N'), 9) AS effect, round((avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'N')) / sqrt(var_samp(l_quantity) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag = 'A') + var_samp(l_quantity) FILTER (l_returnflag = 'N') / count(*) FILTER (l_returnflag = 'N')), 9) AS t FROM lineitem", "lineitem")
def welch_t(lineitem):
    return stats.welch_t(lineitem, "l_quantity", "l_returnflag", "A", "N").select(F.round("effect", 9).alias("effect"), F.round("t", 9).alias("t"))


@query(
    """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT avg(l_quantity) AS m, count(*) AS n FROM lineitem)
    SELECT round((sum(g.n * (g.m - a.m) ** 2) / (count(*) - 1)) / (sum((g.n - 1) * v) / (any_value(a.n) - count(*))), 6) AS f FROM g, a""",
    "lineitem",
)
def anova(lineitem):
    return stats.anova(lineitem, "l_quantity", "l_returnflag").select(F.round("f", 6).alias("f"))


@query(
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT round(any_value(t) * (sum(n * n / (na * nb)) - 1), 6) AS chi2 FROM (SELECT n, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb, sum(n) OVER () AS t FROM c)""",
    "orders",
)
def chi_square(orders):
    return stats.chi_square(orders, "o_orderstatus", "o_orderpriority").select(F.round("chi2", 6).alias("chi2"))


@query("SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem", "lineitem")
def ols(lineitem):
    return stats.ols(lineitem, "l_extendedprice", ["l_quantity"]).select("term", F.round("coefficient", 4).alias("coefficient"))


@query(
    """WITH d AS (SELECT user_id, CAST(floor(max(value)) AS BIGINT) AS t, max(event_id) % 2 = 0 AS e FROM events GROUP BY 1), g AS (SELECT t, count(*) FILTER (e) AS d, count(*) AS l FROM d GROUP BY 1),
    r AS (SELECT t, d, sum(l) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM g)
    SELECT t AS time, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(product(1 - d / n::DOUBLE) OVER (ORDER BY t), 9) AS survival FROM r WHERE d > 0""",
    "events",
)
def km_curve(events_):
    d = events_.groupBy("user_id").agg(F.floor(F.max("value")).alias("t"), (F.max("event_id") % 2 == 0).alias("e"))
    return stats.kaplan_meier(d, "t", "e").select("time", "at_risk", "events", F.round("survival", 9).alias("survival"))


@query(
    """WITH u AS (SELECT user_id, user_id % 2 AS t, avg(value) FILTER (dayofmonth(ts) <= 10) AS y1, avg(value) FILTER (dayofmonth(ts) BETWEEN 11 AND 20) AS y2, avg(value) FILTER (dayofmonth(ts) > 20) AS y3 FROM events GROUP BY 1)
    SELECT round(avg(y3 - y2) FILTER (t = 1) - avg(y3 - y2) FILTER (t = 0), 9) AS effect, round(avg(y2 - y1) FILTER (t = 1) - avg(y2 - y1) FILTER (t = 0), 9) AS placebo, count(*) AS units FROM u WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL""",
    "events",
)
def did(events_):
    p = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
    long = events_.groupBy("user_id", p.alias("p")).agg(F.avg("value").alias("y")).withColumn("t", F.col("user_id") % 2)
    whole = long.groupBy("user_id").count().filter("count = 3").select("user_id")
    return stats.did(long.join(whole, "user_id"), "user_id", "p", "t", "y", (0, 1, 2)).select(F.round("effect", 9).alias("effect"), F.round("placebo", 9).alias("placebo"), "units")


@query("SELECT s AS stratum, count(*) AS n FROM (SELECT o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('s|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) WHERE r <= 50 GROUP BY 1", "orders")
def sample_stratified(orders):
    return stats.sample(orders, "o_orderkey", 50, strata=["o_orderstatus"]).groupBy(F.col("o_orderstatus").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('s|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100", "orders")
def sample_random(orders):
    return stats.sample(orders, "o_orderkey", 100).select("o_orderkey")


_PSI_SQL = """WITH q AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM events WHERE event_id % 2 = 0),
b AS (SELECT len(list_filter(e, lambda x: value > x)) AS b, event_id % 2 AS k, len(e) + 1 AS n FROM events, q),
c AS (SELECT b, any_value(n) AS n, count(*) FILTER (k = 0) + 0.5 AS r, count(*) FILTER (k = 1) + 0.5 AS c FROM b GROUP BY b)
SELECT round(sum((c / tc - r / tr) * ln((c / tc) / (r / tr))), 9) AS psi FROM c, (SELECT sum(r) AS tr, sum(c) AS tc FROM c)"""


@query(_PSI_SQL, "events")
def psi(events_):
    return monitor.psi(events_.filter("event_id % 2 = 0"), events_.filter("event_id % 2 = 1"), "value").select(F.round("psi", 9).alias("psi"))


@query("WITH c AS (SELECT value, count(*) FILTER (event_id % 2 = 0) AS r, count(*) FILTER (event_id % 2 = 1) AS c FROM events GROUP BY 1) SELECT round(max(abs(fr - fc)), 9) AS ks FROM (SELECT sum(r) OVER (ORDER BY value) / CAST(sum(r) OVER () AS DOUBLE) AS fr, sum(c) OVER (ORDER BY value) / CAST(sum(c) OVER () AS DOUBLE) AS fc FROM c)", "events")
def ks(events_):
    return monitor.ks(events_.filter("event_id % 2 = 0"), events_.filter("event_id % 2 = 1"), "value").select(F.round("ks", 9).alias("ks"))


@query("WITH c AS (SELECT value, count(*) FILTER (event_id % 2 = 0) AS r, count(*) FILTER (event_id % 2 = 1) AS c FROM events GROUP BY 1) SELECT round(sum(abs(fr - fc) * g), 6) AS wasserstein FROM (SELECT sum(r) OVER (ORDER BY value) / CAST(sum(r) OVER () AS DOUBLE) AS fr, sum(c) OVER (ORDER BY value) / CAST(sum(c) OVER () AS DOUBLE) AS fc, lead(value) OVER (ORDER BY value) - value AS g FROM c)", "events")
def wasserstein(events_):
    return monitor.wasserstein(events_.filter("event_id % 2 = 0"), events_.filter("event_id % 2 = 1"), "value").select(F.round("wasserstein", 6).alias("wasserstein"))


@query("SELECT date_trunc('day', ts) AS time, round(avg(value), 9) AS value FROM events GROUP BY 1", "events")
def resample_daily(events_):
    return timeseries.resample(events_, "ts", "value", "D").select(F.col("time").cast("timestamp_ntz").alias("time"), F.round("value", 9).alias("value"))


@query(
    """WITH d AS (SELECT date_trunc('day', ts) AS t, count(*) - avg(count(*)) OVER () AS c FROM events GROUP BY 1), p AS (SELECT c, lag(c, 1) OVER (ORDER BY t) AS a, lag(c, 2) OVER (ORDER BY t) AS b FROM d)
    SELECT 1 AS lag, round(sum(c * a) / sum(c * c), 9) AS acf FROM p UNION ALL SELECT 2, round(sum(c * b) / sum(c * c), 9) FROM p""",
    "events",
)
def acf(events_):
    daily = events_.groupBy(F.date_trunc("day", "ts").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return timeseries.acf(daily, "t", "n", 2).withColumn("acf", F.round("acf", 9))


@query("WITH d AS (SELECT date_trunc('day', ts) AS t, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) SELECT t, n, lag(n, 1) OVER (ORDER BY t) AS naive, lag(n, 7) OVER (ORDER BY t) AS seasonal FROM d", "events")
def seasonal_naive(events_):
    daily = events_.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return timeseries.seasonal_naive(daily, "t", "n", 7)


# Tests hold it against brute force over all pairs.
@query(None, "documents")
def similar_docs(documents):
    return text.similar(text.tfidf(documents, "doc_id", "text"))


# --- graphs

@query(None, "nation", "customer", "orders")
def pagerank(nation, customer, orders):
    e = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), (F.col("o_orderkey") % 25).cast("int").alias("dst"))
    return graph.pagerank(e.distinct())


# Graphs of whole tables; orders have their keys as nodes, suppliers and parts have negative ones, so none meet at any scale.

_EDGES = "(SELECT l_orderkey AS src, -1 - l_suppkey AS dst FROM lineitem)"


@query(f"SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {_EDGES} UNION ALL SELECT dst, 1, 0 FROM {_EDGES}) GROUP BY 1", "lineitem")
def degree(lineitem):
    return graph.degrees(lineitem.select(F.col("l_orderkey").alias("src"), F.expr("-1 - l_suppkey").alias("dst"))).select("node", "in_degree", "out_degree", "degree")


# A recursive closure of all orders is quadratic in SQL; tests hold this one and the next against brute force.
@query(None, "orders")
def components(orders):
    return graph.components(orders.select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey - 1 - o_orderkey % 3").alias("dst")))


@query(None, "lineitem")
def shortest_paths(lineitem):
    """Hops from order 0, by way of the parts that orders have in common."""
    return graph.shortest_paths(lineitem.select(F.col("l_orderkey").alias("src"), F.expr("-1 - l_partkey").alias("dst")), 0, directed=False)


# --- models and geometry


@query("SELECT l_orderkey AS k, CASE WHEN ('0x' || substr(md5('split|' || CAST(l_orderkey AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0 < 0.2 THEN 'test' ELSE 'train' END AS part FROM (SELECT DISTINCT l_orderkey FROM lineitem)", "lineitem")
def split_by_group(lineitem):
    return ml.split(lineitem, "l_linenumber", by="l_orderkey", kind="group").select(F.col("l_orderkey").alias("k"), "part").distinct()


@query(
    """WITH c AS (SELECT o_orderstatus = 'F' AS y, o_totalprice > 200000 AS p, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT CAST(k AS DOUBLE) AS class, CAST(sum(n) FILTER (y = (k = 1)) AS BIGINT) AS support, sum(n) FILTER (y = (k = 1) AND p = (k = 1)) / CAST(sum(n) FILTER (p = (k = 1)) AS DOUBLE) AS precision, sum(n) FILTER (y = (k = 1) AND p = (k = 1)) / CAST(sum(n) FILTER (y = (k = 1)) AS DOUBLE) AS recall FROM c, (VALUES (0), (1)) t(k) GROUP BY k""",
    "orders",
)
def class_metrics(orders):
    rows = orders.select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") > 200000).cast("int").alias("prediction"))
    return ml.class_metrics(rows, "y").select("class", "support", "precision", "recall")


@query("SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "events")
def popularity(events_):
    return ml.popularity(events_.withColumnRenamed("event_type", "item"), "item", 3)


@query(
    """WITH p AS (SELECT o_orderkey AS point_id, o_custkey % 100 AS x, o_orderkey % 97 AS y FROM orders), b AS (SELECT s_suppkey AS box_id, s_suppkey % 90 AS x0, s_suppkey % 80 AS y0 FROM supplier)
    SELECT point_id, box_id FROM p JOIN b ON x >= x0 AND x <= x0 + 6 AND y >= y0 AND y <= y0 + 4""",
    "orders", "supplier",
)
def points_in_boxes(orders, supplier):
    p = orders.select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 100).alias("x"), (F.col("o_orderkey") % 97).alias("y"))
    b = supplier.select(F.col("s_suppkey").alias("box_id"), (F.col("s_suppkey") % 90).alias("x0"), (F.col("s_suppkey") % 80).alias("y0"))
    return geo.points_in_boxes(p, b.select("*", (F.col("x0") + 6).alias("x1"), (F.col("y0") + 4).alias("y1")), 10.0)


@query(
    """WITH m AS (SELECT avg(n_nationkey) AS m, count(*) AS n FROM nation), z AS (SELECT n_nationkey AS k, n_regionkey AS g, n_nationkey - m AS z FROM nation, m),
    p AS (SELECT a.z AS zi, b.z AS zj FROM z a JOIN z b ON a.g = b.g AND a.k <> b.k)
    SELECT round(any_value(n) / CAST((SELECT count(*) FROM p) AS DOUBLE) * (SELECT sum(zi * zj) FROM p) / (SELECT sum(z * z) FROM z), 9) AS moran_i FROM m""",
    "nation",
)
def moran(nation):
    a, b = nation.select(F.col("n_nationkey").alias("src"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    near = a.join(b, "n_regionkey").filter("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))
    return geo.moran(nation, near, "n_nationkey", "n_nationkey").select(F.round("moran_i", 9).alias("moran_i"))


@query(None, "customer")
def kmeans_clusters(customer):
    return ml.cluster(customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n")), ["c_acctbal", "n"], k=4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(None, "lineitem")
def linear_model(lineitem):
    rows = ml.split(lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice"), "l_orderkey")
    model = ml.fit(rows.filter("part = 'train'"), "l_extendedprice", ["l_quantity", "l_discount"], family="linear", task="regression")
    return ml.regression_metrics(ml.predict(model, rows.filter("part = 'test'")), "l_extendedprice")


@query(None, "supplier")
def dbscan_clusters(supplier):
    return ml.dbscan(supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 500).alias("y")), "s_suppkey", "x", "y", 1.5, 3)

"""Queries of charts, maps, experiments, series and feedback that the other modules don't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import charts, events, geo, graph, ml, monitor, profile, quality, stats, text, timeseries
from ..streaming import streams
from .queries import query


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _uniform(seed: str, column: str) -> str:
    """SQL of a number in [0, 1) by the seeded hash of a column."""
    return f"(('0x' || substr(md5('{seed}|' || {column}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


# --- charts and maps


@query(
    """WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem), p AS (SELECT (l_quantity - x0) / (x1 - x0) * 12 AS u, (l_extendedprice - y0) / (y1 - y0) * 6 AS v FROM lineitem, b),
    q AS (SELECT round_even(u, 0) AS a, round_even(v, 0) AS b, floor(u) + 0.5 AS c, floor(v) + 0.5 AS d, u, v FROM p), s AS (SELECT *, (u - a) * (u - a) + 3 * (v - b) * (v - b) < (u - c) * (u - c) + 3 * (v - d) * (v - d) AS f FROM q)
    SELECT round(CASE WHEN f THEN a ELSE c END * ((x1 - x0) / 12) + x0, 4) AS cx, round(CASE WHEN f THEN s.b ELSE d END * ((y1 - y0) / 6) + y0, 4) AS cy, count(*) AS n FROM s, b GROUP BY 1, 2""",
    "lineitem",
)
def chart_hexbin(lineitem):
    return _rounded(charts.hexbin(lineitem, "l_quantity", "l_extendedprice", 12), 4, "cx", "cy")


@query(
    """WITH r AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, min(c_nationkey) AS c, max(c_nationkey) AS d FROM customer), s AS (SELECT c_mktsegment AS entity, avg((c_acctbal - a) / (b - a)) AS p, avg((c_nationkey - c) / (d - c)) AS q FROM customer, r GROUP BY 1)
    SELECT entity, 'c_acctbal' AS axis, round(p, 9) AS value FROM s UNION ALL SELECT entity, 'c_nationkey', round(q, 9) FROM s""",
    "customer",
)
def chart_radar(customer):
    return _rounded(charts.radar(customer, "c_mktsegment", ["c_acctbal", "c_nationkey"]), 9, "value")


@query(
    """SELECT 's' || s_suppkey AS node, 0 AS level, 0.0::DOUBLE AS inflow, 1.0::DOUBLE AS outflow FROM supplier UNION ALL SELECT 'n' || s_nationkey, 1, count(*)::DOUBLE, count(*)::DOUBLE FROM supplier GROUP BY s_nationkey
    UNION ALL SELECT 'r' || n_regionkey, 2, count(*)::DOUBLE, 0.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey""",
    "supplier",
    "nation",
)
def chart_flow(supplier, nation):
    first = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    second = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return charts.flow_levels(first.unionByName(second).withColumn("amount", F.lit(1.0)), "source", "target", "amount")


@query(
    """SELECT s_suppkey, round(2 * 6371008.8 * asin(least(1, sqrt(sin((0.5 - radians(s_acctbal / 200)) / 2) ** 2 + cos(radians(s_acctbal / 200)) * cos(0.5) * sin((0.25 - radians(s_suppkey % 360 - 180)) / 2) ** 2))), 3) AS metres,
    round(radians(s_suppkey % 360 - 180) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(s_acctbal / 200) / 2)) * 6378137.0, 3) AS y FROM supplier""",
    "supplier",
)
def geo_distance(supplier):
    lon, lat = (F.col("s_suppkey") % 360 - 180).cast("double"), F.col("s_acctbal") / 200
    flat = geo.mercator(lon, lat)
    far = geo.haversine(lon, lat, F.degrees(F.lit(0.25)), F.degrees(F.lit(0.5)))
    return _rounded(supplier.select("s_suppkey", far.alias("metres"), flat["x"].alias("x"), flat["y"].alias("y")), 3, "metres", "x", "y")


@query("SELECT CAST(floor(user_id / 10) AS BIGINT) AS cx, CAST(floor(value / 10) AS BIGINT) AS cy, count(*) AS n, count(*) / 100.0::DOUBLE AS per_unit FROM events GROUP BY 1, 2", "events")
def geo_grid_density(events_):
    return geo.grid_density(events_, "user_id", "value", 10.0)


@query(
    """WITH f AS (SELECT user_id, date_trunc('week', min(ts)) AS c FROM events GROUP BY 1), s AS (SELECT CAST(c AS DATE) AS cohort, CAST(date_diff('day', c, date_trunc('week', ts)) / 7 AS INTEGER) AS "offset", count(DISTINCT user_id) AS entities FROM events JOIN f USING (user_id) GROUP BY 1, 2)
    SELECT *, round(entities / max(entities) FILTER ("offset" = 0) OVER (PARTITION BY cohort), 9) AS rate FROM s""",
    "events",
)
def retention_rates(events_):
    return _rounded(events.retention(events.cohort(events_, "user_id", "ts", "week")).withColumn("cohort", F.to_date("cohort")), 9, "rate")


@query(
    """WITH e AS (SELECT o_custkey % 30 AS a, o_orderkey % 31 AS b FROM orders), m AS (SELECT count(*) AS m FROM e), d AS (SELECT c, count(*) AS d FROM (SELECT a % 3 AS c FROM e UNION ALL SELECT b % 3 FROM e) GROUP BY 1), i AS (SELECT a % 3 AS c, count(*) AS i FROM e WHERE a % 3 = b % 3 GROUP BY 1)
    SELECT round(sum(coalesce(i, 0) / m - (d / (2.0 * m)) ** 2), 9) AS modularity FROM d LEFT JOIN i USING (c), m""",
    "orders",
)
def graph_modularity(orders):
    edges = orders.select((F.col("o_custkey") % 30).alias("src"), (F.col("o_orderkey") % 31).alias("dst"))
    groups = orders.sparkSession.range(31).select(F.col("id").alias("node"), (F.col("id") % 3).alias("community"))
    return _rounded(graph.modularity(edges, groups), 9, "modularity")


# --- experiments, tests and folds


@query(f"SELECT c_custkey, CASE WHEN u < 1 THEN 'a' WHEN u < 3 THEN 'b' ELSE 'c' END AS arm FROM (SELECT c_custkey, {_uniform('a', 'c_custkey')} * 4 AS u FROM customer)", "customer")
def assign_arms(customer):
    return stats.assign(customer, "c_custkey", {"a": 1, "b": 2, "c": 1}).select("c_custkey", "arm")


@query(f"SELECT c_custkey, CAST(floor({_uniform('folds', 'c_custkey')} * 5) AS INTEGER) AS fold FROM customer", "customer")
def cv_folds(customer):
    return ml.folds(customer, "c_custkey", 5).select("c_custkey", "fold")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT k FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) ORDER BY md5('s|' || k), k LIMIT 40) GROUP BY 1", "lineitem")
def sample_clusters(lineitem):
    return stats.sample_clusters(lineitem, "l_orderkey", 40).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH g AS (SELECT o_orderkey % 2 AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT round(t.m - c.m, 4) AS effect, round((t.m - c.m) / sqrt(t.v / t.n + c.v / c.n), 6) AS t, round((t.m - c.m) / c.m, 9) AS relative FROM g t, g c WHERE t.g = 1 AND c.g = 0""",
    "orders",
)
def experiment_effect(orders):
    got = stats.experiment(orders.withColumn("arm", F.col("o_orderkey") % 2), "arm", "o_totalprice", 0, 1)
    return got.select(F.round("effect", 4).alias("effect"), F.round("t", 6).alias("t"), F.round("relative", 9).alias("relative"))


@query(
    """WITH s AS (SELECT s_acctbal > 5000 AS a, s_nationkey % 2 = 0 AS b FROM supplier), t AS (SELECT count(*) FILTER (a AND b) AS x, count(*) FILTER (a AND NOT b) AS y, count(*) FILTER (b AND NOT a) AS z, count(*) FILTER (NOT a AND NOT b) AS w, count(*) AS n FROM s),
    k AS (SELECT i AS k, x, exp(lgamma(x + y + 1) + lgamma(z + w + 1) + lgamma(x + z + 1) + lgamma(y + w + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - lgamma(x + z - i + 1) - lgamma(w - x + i + 1)) AS p FROM t, range(100000) r(i) WHERE i >= greatest(0, x - w) AND i <= least(x + y, x + z))
    SELECT round(any_value(x * w / (y * z)), 9) AS odds_ratio, round(least(1, (SELECT sum(p) FROM k WHERE p <= (SELECT p FROM k WHERE k.k = k.x) * (1 + 1e-7))), 6) AS p FROM t""",
    "supplier",
)
def fisher_exact(supplier):
    return stats.fisher_2x2(supplier.select((F.col("s_acctbal") > 5000).alias("a"), (F.col("s_nationkey") % 2 == 0).alias("b")), "a", "b").select(F.round("odds_ratio", 9).alias("odds_ratio"), F.round("p", 6).alias("p"))


@query(
    """WITH s AS (SELECT count(*)::DOUBLE AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT n, round(r, 9) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 9) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 9) AS high FROM s""",
    "lineitem",
)
def pearson_interval(lineitem):
    return _rounded(stats.pearson(lineitem, "l_quantity", "l_extendedprice").select("n", "r", "low", "high"), 9, "r", "low", "high")


@query(
    """WITH g AS (SELECT l_orderkey % 2 AS z, avg(l_extendedprice) AS y, avg((l_quantity + 15 * (l_orderkey % 2) > 30)::INTEGER) AS d FROM lineitem GROUP BY 1)
    SELECT round((a.y - b.y) / (a.d - b.d), 3) AS effect, round(a.d - b.d, 9) AS first_stage FROM g a, g b WHERE a.z = 1 AND b.z = 0""",
    "lineitem",
)
def instrument_effect(lineitem):
    rows = lineitem.withColumn("z", F.col("l_orderkey") % 2).withColumn("d", (F.col("l_quantity") + 15 * F.col("z") > 30).cast("int"))
    return stats.wald_iv(rows, "l_extendedprice", "d", "z").select(F.round("effect", 3).alias("effect"), F.round("first_stage", 9).alias("first_stage"))


@query("SELECT CAST(k AS INTEGER) AS component, round((1 + (CASE WHEN k = 1 THEN 1 ELSE -1 END) * abs(r)) / 2, 9) AS share FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), (SELECT unnest([1, 2]) AS k)", "lineitem")
def pca_shares(lineitem):
    shares = ml.pca(lineitem.select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 2)[1]
    return _rounded(lineitem.sparkSession.createDataFrame(list(enumerate(shares, 1)), "component int, share double"), 9, "share")


# --- series


@query(
    """WITH u AS (SELECT user_id, ts, value, lead(ts) OVER w AS next, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS n, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY user_id) AS m, sum(value) OVER (PARTITION BY user_id) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, s * s / n + (t - s) * (t - s) / (m - n) AS gain FROM u WHERE n < m) SELECT user_id, max_by(next, gain) AS change_at, round(max_by(s / n, gain), 9) AS before, round(max_by((t - s) / (m - n), gain), 9) AS "after" FROM g GROUP BY 1""",
    "events",
)
def change_points(events_):
    return _rounded(timeseries.change_point(events_, "ts", "value", ["user_id"]), 9, "before", "after").filter("change_at is not null").withColumn("change_at", F.col("change_at").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, date_trunc('day', max(ts))::TIMESTAMP, INTERVAL 1 DAY)) AS time FROM events GROUP BY 1)
    SELECT user_id, time FROM g ANTI JOIN (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS time FROM events) h USING (user_id, time)""",
    "events",
)
def series_gaps(events_):
    return timeseries.gaps(events_, "ts", "D", ["user_id"]).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS time, round(sum(value), 4) AS value FROM events GROUP BY 1", "events")
def series_on_grid(events_):
    daily = timeseries.resample(events_, "ts", "value", "D", "sum")
    return _rounded(timeseries.normalise(daily, "time", "value", "D").withColumn("time", F.col("time").cast("timestamp_ntz")), 4, "value")


@query(
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS v FROM events), d AS (SELECT user_id, v, i - lag(i, 1, 0) OVER w AS gap, row_number() OVER w AS j, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE v > 0 WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    s AS (SELECT user_id, sum(v * k) AS demand, sum(gap * k) AS interval FROM (SELECT *, CASE WHEN j = 1 THEN 1 ELSE 0.2 END * 0.8 ** (n - j) AS k FROM d) GROUP BY 1)
    SELECT u.user_id, round(demand, 6) AS demand, round(interval, 6) AS interval, round(coalesce(demand / interval, 0), 6) AS forecast FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s USING (user_id)""",
    "events",
)
def croston_demand(events_):
    rows = events_.withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    return _rounded(timeseries.croston(rows, "ts", "v", 0.2, ["user_id"]), 6, "demand", "interval", "forecast")


@query(
    """WITH d AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS time, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time) AS i FROM d),
    l AS (SELECT a.user_id, a.time, a.v, a.i, sum(b.v * CASE WHEN b.i = 1 THEN 1 ELSE 0.25 END * 0.75 ** (a.i - b.i)) AS level FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY ALL)
    SELECT user_id, time, v AS value, round(lag(level) OVER (PARTITION BY user_id ORDER BY i), 9) AS forecast FROM l""",
    "events",
)
def exponential_smoothing(events_):
    daily = events_.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return timeseries.smooth(daily, "time", "v", 0.25, ["user_id"]).select("user_id", "time", "value", F.round(F.nanvl("forecast", F.lit(None)), 9).alias("forecast"))


# --- monitoring and feedback


@query(
    """WITH c AS (SELECT o_orderpriority AS v, count(*) FILTER (o_orderkey % 3 > 0) AS r, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderstatus <> 'P') AS c FROM orders GROUP BY 1), p AS (SELECT r / sum(r) OVER () AS p, c / sum(c) OVER () AS q, r FROM c)
    SELECT round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS js_distance, count(*) FILTER (r = 0) AS unseen FROM p""",
    "orders",
)
def category_drift(orders):
    return _rounded(monitor.category_drift(orders.filter("o_orderkey % 3 > 0"), orders.filter("o_orderkey % 3 = 0 and o_orderstatus <> 'P'"), "o_orderpriority"), 6, "js_distance")


@query(
    """WITH p AS (SELECT event_id, ts AS made FROM events), l AS (SELECT event_id, ts + to_days(CAST(event_id % 5 AS INTEGER)) AS arrived FROM events WHERE event_id % 4 <> 0), j AS (SELECT made, arrived FROM p LEFT JOIN (SELECT * FROM l WHERE arrived <= TIMESTAMP '2024-01-20') USING (event_id))
    SELECT count(arrived) AS matched, count(*) FILTER (arrived IS NULL AND NOT made + INTERVAL 3 DAY < TIMESTAMP '2024-01-20') AS waiting, count(*) FILTER (arrived IS NULL AND made + INTERVAL 3 DAY < TIMESTAMP '2024-01-20') AS overdue FROM j""",
    "events",
)
def delayed_labels(events_):
    p = events_.select("event_id", F.col("ts").cast("timestamp").alias("at"))
    labels = events_.filter("event_id % 4 <> 0").selectExpr("event_id", "cast(ts as timestamp) + make_dt_interval(cast(event_id % 5 as int)) AS arrived")
    return monitor.delayed(p, labels, "event_id", "2024-01-20 00:00:00", "3 days")


@query(
    """WITH e AS (SELECT least(value / 100, 1) AS s, (event_type = 'error')::INTEGER AS y FROM events), b AS (SELECT least(9, floor(s * 10)) AS bin, count(*) AS n, abs(avg(s) - avg(y)) AS d FROM e GROUP BY 1) SELECT round(sum(n * d) / sum(n), 9) AS ece FROM b""",
    "events",
)
def calibration_error(events_):
    rows = events_.select((F.col("event_type") == "error").cast("int").alias("y"), F.least(F.col("value") / 100, F.lit(1.0)).alias("s"))
    return _rounded(monitor.expected_calibration_error(rows, "y", "s"), 9, "ece")


@query(
    """WITH m AS (SELECT l_suppkey AS u, l_partkey AS i, max(l_extendedprice) AS v, max((l_returnflag = 'R')::INTEGER) AS good FROM lineitem GROUP BY 1, 2), r AS (SELECT u, i, good, row_number() OVER (PARTITION BY u ORDER BY v DESC, i) AS k FROM m),
    t AS (SELECT u, k, good, sum(good) OVER (PARTITION BY u ORDER BY k) AS found FROM r WHERE k <= 5), a AS (SELECT u, sum(good) AS h, sum(good / log2(k + 1)) AS dcg, sum(good * found / k) AS ap FROM t GROUP BY 1), w AS (SELECT u, sum(good) AS r FROM m GROUP BY 1 HAVING sum(good) > 0)
    SELECT u, h / 5 AS precision, round(h / r, 9) AS recall, round(dcg / (SELECT sum(1 / log2(j + 1)) FROM range(1, 6) x(j) WHERE j <= r), 9) AS ndcg, round(ap / least(r, 5), 9) AS ap FROM a LEFT JOIN w USING (u)""",
    "lineitem",
)
def ranking_quality(lineitem):
    items = lineitem.groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("i")).agg(F.max("l_extendedprice").alias("v"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("good"))
    ranked = items.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.col("v").desc(), "i"))).select("u", "i", "k")
    return _rounded(monitor.ranking_metrics(ranked, items.filter("good = 1").select("u", "i"), "u", "i", "k", 5), 9, "recall", "ndcg", "ap")


@query("SELECT event_id, min(value) OVER (ORDER BY event_id) AS low FROM events", "events")
def running_low(events_):
    return monitor.running_min(events_, "event_id", "value", "low").select("event_id", "low")


@query("SELECT * FROM (VALUES ('c_custkey', 'same'), ('c_name', 'removed'), ('c_nationkey', 'type_changed'), ('c_acctbal', 'same'), ('c_mktsegment', 'same'), ('region', 'added')) AS t(\"column\", change)", "customer")
def schema_changes(customer):
    after = customer.drop("c_name").withColumn("c_nationkey", F.col("c_nationkey").cast("bigint")).withColumn("region", F.lit("x"))
    return customer.sparkSession.createDataFrame(profile.schema_changes(customer, after), "column string, change string")


@query(
    """SELECT p.event_id, l.event_id AS label_id FROM events p JOIN events l ON p.user_id = l.user_id AND l.ts >= p.ts AND l.ts <= p.ts + INTERVAL 2 HOUR WHERE p.event_type = 'click' AND l.event_type = 'purchase'""",
    "events",
)
def stream_feedback(events_):
    p = events_.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    labels = events_.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("label_id"), F.col("ts").alias("due"))
    return streams.feedback(p, labels, "user_id", "ts", "due", "10 minutes", "2 hours").select("event_id", "label_id")


@query(
    """SELECT doc_id, entity, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+')) AS term FROM documents) JOIN (VALUES ('article', 'the'), ('article', 'der'), ('joint', 'and'), ('joint', 'und')) AS d(entity, term) USING (term) GROUP BY 1, 2""",
    "documents",
)
def text_entities(documents):
    names = documents.sparkSession.createDataFrame([("article", "the"), ("article", "Der"), ("joint", "and"), ("joint", "und")], "entity string, term string")
    return text.entities(documents, "doc_id", "text", names)


# Likeness by matching blocks has no SQL; tests hold it against the standard library's.
@query(None, "part")
def similar_names(part):
    return quality.similar_categories(part, "p_name", 0.8)

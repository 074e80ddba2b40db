"""Queries of models, survival, causal contrasts, signals, monitoring and the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts, cleaning, events, glm, monitor, privacy, project, relational, signals, stats, survival, timeseries, windows
from ..sources import sinks
from ..streaming import streams
from .queries import query


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- projection and filters


@query("SELECT c_custkey, c_name AS customer, c_nationkey, c_acctbal, c_mktsegment FROM customer", "customer")
def rename_column(customer):
    return project.rename(customer, "c_name", "customer")


@query("SELECT c_custkey, c_acctbal FROM customer", "customer")
def drop_columns(customer):
    return project.drop(customer, ["c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", "customer")
def filter_by_ids(orders, customer):
    keys = orders.join(customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return project.by_ids(orders, keys, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 25", "supplier")
def first_rows(supplier):
    return project.first_rows(supplier, "s_suppkey", 25).select("s_suppkey", "s_name")


@query("SELECT c_custkey, abs(-c_acctbal) AS size, -c_acctbal AS turned FROM customer", "customer")
def formula_unary(customer):
    return project.computed(project.computed(customer, "size", 'abs(-col("c_acctbal"))'), "turned", '-col("c_acctbal")').select("c_custkey", "size", "turned")


@query(
    """WITH r AS (SELECT *, p_partkey - min(p_partkey) OVER () AS i, count(*) OVER () AS n FROM part)
    SELECT p_partkey FROM r WHERE i IN (SELECT (j * (SELECT count(*) FROM part)) // 37 FROM range(37) t(j))""",
    "part",
)
def systematic_sample(part):
    return windows.systematic_sample(part.crossJoin(F.broadcast(part.agg(F.min("p_partkey").alias("low")))).withColumn("i", F.col("p_partkey") - F.col("low")), "i", 37).select("p_partkey")


@query(
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
    SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a)""",
    "orders",
)
def outlier_filter(orders):
    return cleaning.outliers_iqr(orders, "o_totalprice", 0.4, "drop").select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, (SELECT min(b.s_suppkey) FROM supplier b WHERE b.s_nationkey = a.s_nationkey) AS canonical_id FROM supplier a", "supplier")
def entity_merge(supplier):
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("left_id"))
    pairs = supplier.join(first, "s_nationkey").filter("left_id <> s_suppkey").select("left_id", F.col("s_suppkey").alias("right_id"))
    return cleaning.entity_merge(supplier, "s_suppkey", pairs).select("s_suppkey", "canonical_id")


@query("SELECT count(*) AS inner_rows, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS left_unmatched, CAST(0 AS BIGINT) AS right_unmatched FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "customer", "orders")
def keyed_pairs(customer, orders):
    return relational.keyed_pairs(customer, orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")[1]


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN '\\N' ELSE c_name END AS t FROM customer", "customer")
def sink_escaped(customer):
    return sinks.escaped(customer.select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN '=' || c_name WHEN c_custkey % 3 = 2 THEN c_name END").alias("t")))


@query(
    """SELECT c_custkey AS column_1, '[redacted]' AS column_2, sha256('k|' || sha256('k|' || c_mktsegment)) AS column_3 FROM customer""",
    "customer",
)
def privacy_policy(customer):
    return privacy.project(customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), {"c_custkey": "keep", "c_mktsegment": "pseudonym", "c_acctbal": "drop"}, "k")


# --- windows and charts


@query(
    """SELECT event_id, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, CASE WHEN count(value) OVER b = 3 THEN round(avg(value) OVER b, 6) END AS rolling_3
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "events",
)
def lag_rolling(events_):
    return _rounded(windows.lag_features(events_, "value", "event_id", [1, 2], 3, ["user_id"]).select("event_id", "lag_1", "lag_2", "rolling_3"), 6, "rolling_3")


@query("SELECT p_partkey, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) AS total FROM part", "part")
def waterfall(part):
    return windows.waterfall(part.withColumn("kind", F.lit("change")), "p_partkey", "kind", "p_size").select("p_partkey", F.col("total").cast("bigint").alias("total"))


@query(
    """WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), f AS (SELECT CAST(least(9, floor((l_quantity - a) / ((b - a) / 10))) AS INTEGER) AS bin, sum(l_extendedprice) AS n FROM lineitem, r GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(coalesce(n, 0), 2) AS n FROM range(10) t(i) LEFT JOIN f ON bin = i""",
    "lineitem",
)
def chart_hist_weighted(lineitem):
    return _rounded(charts.histogram(lineitem, "l_quantity", 10, "l_extendedprice").select("bin", "n"), 2, "n")


@query("SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS x, o_orderstatus AS series, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1, 2", "orders")
def chart_line(orders):
    return _rounded(charts.line(orders.withColumn("day", F.date_trunc("day", "o_orderdate")), "day", "o_totalprice", "mean", "o_orderstatus"), 4, "y")


@query("SELECT l_returnflag AS x, l_linenumber AS y, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2", "lineitem")
def chart_heatmap(lineitem):
    return _rounded(charts.cell_heatmap(lineitem, "l_returnflag", "l_linenumber", "l_quantity"), 6, "value")


@query("SELECT 'k' AS \"column\", CAST(0 AS BIGINT) AS missing, count(*) AS rows, 0.0::DOUBLE AS rate FROM orders UNION ALL SELECT 's', count(*) FILTER (o_orderstatus = 'P'), count(*), count(*) FILTER (o_orderstatus = 'P') / count(*) FROM orders", "orders")
def chart_missing_rates(orders):
    return charts.missing_rates(orders.select(F.col("o_orderkey").alias("k"), F.expr("nullif(o_orderstatus, 'P')").alias("s")))


@query(
    """WITH m AS (SELECT count(*) AS n, stddev_samp(l_quantity) * power(count(*), -0.2) AS h, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), c AS (SELECT l_quantity AS v, count(*) AS w FROM lineitem GROUP BY 1),
    g AS (SELECT a - 3 * h + i * (b - a + 6 * h) / 31 AS x, n, h FROM m, range(32) t(i))
    SELECT round(x, 6) AS x, round(sum(w * exp(-0.5 * ((x - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM g, c GROUP BY x""",
    "lineitem",
)
def chart_kde(lineitem):
    return charts.kde(lineitem, "l_quantity", "scott", 32).select(F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


# --- streams, over what is there


@query(
    """SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * j AS s FROM events, range(2) t(j)) GROUP BY 1""",
    "events",
)
def stream_sliding(events_):
    return streams.sliding(events_, "ts", "2 hours", "1 hour", "10 minutes")


@query(
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC) AS g FROM a)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, g""",
    "events",
)
def stream_sessions(events_):
    return streams.sessions(events_, "ts", "6 hours", "10 minutes", "user_id")


# --- tests and models


_RANKED = "WITH a AS (SELECT l_returnflag = 'R' AS g, l_quantity AS v FROM lineitem), c AS (SELECT v, count(*) AS t FROM a GROUP BY 1), k AS (SELECT v, sum(t) OVER (ORDER BY v) - (t - 1) / 2.0 AS r FROM c)"


@query(
    f"{_RANKED}, s AS (SELECT sum(r) FILTER (NOT g) AS ra, count(*) FILTER (NOT g) AS na, count(*) FILTER (g) AS nb FROM a JOIN k USING (v)) SELECT CAST(ra - na * (na + 1) / 2 AS DOUBLE) AS u, round(2 * (ra - na * (na + 1) / 2) / (na * nb) - 1, 9) AS effect FROM s",
    "lineitem",
)
def mann_whitney(lineitem):
    return _rounded(stats.mann_whitney(lineitem.withColumn("g", F.col("l_returnflag") == "R"), "l_quantity", "g").select("u", "effect"), 9, "effect")


@query(
    """WITH c AS (SELECT l_quantity AS v, count(*) AS t FROM lineitem GROUP BY 1), k AS (SELECT v, sum(t) OVER (ORDER BY v) - (t - 1) / 2.0 AS r FROM c), g AS (SELECT l_returnflag, count(*) AS n, sum(r) AS s FROM lineitem JOIN k ON v = l_quantity GROUP BY 1),
    x AS (SELECT sum(n) AS n, sum(s * s / n) AS q, count(*) AS k FROM g) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (SELECT sum(t::DOUBLE ** 3 - t) FROM c) / (n::DOUBLE ** 3 - n)), 6) AS h, CAST(k - 1 AS DOUBLE) AS df FROM x""",
    "lineitem",
)
def kruskal(lineitem):
    return _rounded(stats.kruskal(lineitem, "l_quantity", "l_returnflag").select("h", "df"), 6, "h")


@query(
    """WITH d AS (SELECT abs(l_tax * 100 - l_discount * 100)::INTEGER AS m, round(l_tax * 100) > round(l_discount * 100) AS up FROM lineitem WHERE round(l_tax * 100) <> round(l_discount * 100)), c AS (SELECT m, count(*) AS t FROM d GROUP BY 1),
    k AS (SELECT m, sum(t) OVER (ORDER BY m) - (t - 1) / 2.0 AS r FROM c), s AS (SELECT count(*) AS n, sum(r) FILTER (up) AS p FROM d JOIN k USING (m))
    SELECT CAST(least(p, n * (n + 1) / 2 - p) AS DOUBLE) AS w, round(2 * p / (n * (n + 1) / 2) - 1, 9) AS effect FROM s""",
    "lineitem",
)
def wilcoxon(lineitem):
    cents = lineitem.select(F.round(F.col("l_tax") * 100).cast("int").alias("a"), F.round(F.col("l_discount") * 100).cast("int").alias("b"))
    return _rounded(stats.wilcoxon(cents, "b", "a").select("w", "effect"), 9, "effect")


@query("SELECT round(avg(d), 9) AS effect, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM (SELECT l_tax - l_discount AS d FROM lineitem)", "lineitem")
def paired_t(lineitem):
    return stats.paired_t(lineitem, "l_discount", "l_tax").select(F.round("effect", 9).alias("effect"), F.round("t", 6).alias("t"))


@query("SELECT 1.0 + count(*) FILTER (o_orderstatus = 'F') AS alpha, 1.0 + count(*) FILTER (o_orderstatus <> 'F') AS beta, round((1.0 + count(*) FILTER (o_orderstatus = 'F')) / (2 + count(*)), 9) AS mean FROM orders", "orders")
def beta_binomial(orders):
    return _rounded(stats.beta_binomial(orders.withColumn("s", F.col("o_orderstatus") == "F"), "s").select("alpha", "beta", "mean"), 9, "mean")


_ODDS = "SELECT count(*) FILTER (x = 0 AND y = 1)::DOUBLE AS a, count(*) FILTER (x = 0 AND y = 0)::DOUBLE AS b, count(*) FILTER (x = 1 AND y = 1)::DOUBLE AS c, count(*) FILTER (x = 1 AND y = 0)::DOUBLE AS d FROM (SELECT (l_quantity > 30)::INTEGER AS x, (l_returnflag = 'R')::INTEGER AS y FROM lineitem)"


def _binary(lineitem: DataFrame) -> DataFrame:
    return lineitem.withColumns({"x": (F.col("l_quantity") > 30).cast("int"), "y": (F.col("l_returnflag") == "R").cast("int")})


@query(f"WITH n AS ({_ODDS}) SELECT 'intercept' AS term, round(ln(a / b), 6) AS coefficient, round(sqrt(1 / a + 1 / b), 6) AS se FROM n UNION ALL SELECT 'x', round(ln(c / d) - ln(a / b), 6), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) FROM n", "lineitem")
def glm_logistic(lineitem):
    return _rounded(glm.glm(_binary(lineitem), "y", ["x"]).select("term", "coefficient", "se"), 6, "coefficient", "se")


_POISSON = "SELECT sum(l_linenumber) FILTER (l_quantity <= 30)::DOUBLE AS s0, count(*) FILTER (l_quantity <= 30) AS n0, sum(l_linenumber) FILTER (l_quantity > 30)::DOUBLE AS s1, count(*) FILTER (l_quantity > 30) AS n1 FROM lineitem"


@query(f"WITH n AS ({_POISSON}) SELECT 'intercept' AS term, round(ln(s0 / n0), 6) AS coefficient, round(sqrt(1 / s0), 6) AS se FROM n UNION ALL SELECT 'x', round(ln(s1 / n1) - ln(s0 / n0), 6), round(sqrt(1 / s0 + 1 / s1), 6) FROM n", "lineitem")
def glm_poisson(lineitem):
    return _rounded(glm.glm(_binary(lineitem), "l_linenumber", ["x"], "poisson").select("term", "coefficient", "se"), 6, "coefficient", "se")


@query(
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS q, count(*) AS n FROM lineitem)
    SELECT 'l_quantity' AS term, round(any_value(b), 4) AS coefficient, round(sqrt(sum((l_quantity - q) ** 2 * (l_extendedprice - a - b * l_quantity) ** 2) / sum((l_quantity - q) ** 2) ** 2 * any_value(n) / (any_value(n) - 2)), 4) AS se FROM lineitem, m""",
    "lineitem",
)
def ols_robust(lineitem):
    return _rounded(glm.glm(lineitem, "l_extendedprice", ["l_quantity"], "gaussian", "robust").filter("term = 'l_quantity'").select("term", "coefficient", "se"), 4, "coefficient", "se")


# With one binary covariate the models are saturated, so the three estimates agree with strata weighted by their size.
_STRATA = "WITH c AS (SELECT (l_linenumber > 3)::INTEGER AS x, count(*) AS n, avg(l_extendedprice) FILTER (l_quantity > 30) - avg(l_extendedprice) FILTER (l_quantity <= 30) AS d FROM lineitem GROUP BY 1) SELECT round(sum(n * d) / sum(n), 3) AS effect, CAST(sum(n) AS DOUBLE) AS n FROM c"


def _effect(lineitem: DataFrame, method: str) -> DataFrame:
    rows = lineitem.withColumns({"t": (F.col("l_quantity") > 30).cast("int"), "x": (F.col("l_linenumber") > 3).cast("int")})
    return _rounded(glm.effect(rows, "l_extendedprice", "t", ["x"], method).select("effect", "n"), 3, "effect")


@query(_STRATA, "lineitem")
def causal_regression(lineitem):
    return _effect(lineitem, "regression")


@query(_STRATA, "lineitem")
def causal_ipw(lineitem):
    return _effect(lineitem, "ipw")


@query(_STRATA, "lineitem")
def causal_aipw(lineitem):
    return _effect(lineitem, "aipw")


@query(
    """WITH c AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R') AS n0, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') AS d FROM lineitem GROUP BY 1, 2)
    SELECT round(sum(n1 * d) FILTER (n0 > 0) / sum(n1) FILTER (n0 > 0), 6) AS effect, CAST(coalesce(sum(n1) FILTER (n0 > 0), 0) AS BIGINT) AS treated, CAST(coalesce(sum(n1) FILTER (n0 = 0), 0) AS BIGINT) AS unmatched FROM c""",
    "lineitem",
)
def causal_matched(lineitem):
    return _rounded(glm.matched(lineitem.withColumn("t", (F.col("l_returnflag") == "R").cast("int")), "l_quantity", "t", ["l_suppkey", "l_linenumber"]), 6, "effect")


# --- survival


_SPANS = "WITH u AS (SELECT user_id, CAST(floor(max(value)) AS BIGINT) AS t, CAST(floor(min(value)) AS BIGINT) AS e, max(event_id) % 3 AS c, user_id % 2 AS g FROM events GROUP BY 1)"


def _spans(events_: DataFrame) -> DataFrame:
    return events_.groupBy("user_id").agg(F.floor(F.max("value")).alias("t"), F.floor(F.min("value")).alias("e"), (F.max("event_id") % 3).alias("c")).withColumn("g", F.col("user_id") % 2)


@query(
    f"""{_SPANS}, d AS (SELECT t, count(*) FILTER (c > 0) AS d, count(*) AS l FROM u GROUP BY 1), r AS (SELECT t, d, sum(l) OVER (ORDER BY t DESC) AS n FROM d)
    SELECT t AS time, CAST(n AS BIGINT) AS at_risk, d AS events, round(sum(d / n) OVER (ORDER BY t), 9) AS hazard, round(sum(d / (n * n)) OVER (ORDER BY t), 9) AS variance FROM r WHERE d > 0""",
    "events",
)
def nelson_aalen(events_):
    return _rounded(survival.nelson_aalen(_spans(events_).withColumn("d", F.col("c") > 0), "t", "d"), 9, "hazard", "variance")


@query(
    f"""{_SPANS}, d AS (SELECT t, count(*) AS d FROM u WHERE e < t AND c > 0 GROUP BY 1), r AS (SELECT d.t, d.d, (SELECT count(*) FROM u WHERE u.t >= d.t AND u.e < d.t AND u.e < u.t) AS n FROM d)
    SELECT t AS time, n AS at_risk, d AS events, round(sum(d / n) OVER (ORDER BY t), 9) AS hazard FROM r""",
    "events",
)
def delayed_entry(events_):
    return _rounded(survival.nelson_aalen(_spans(events_).withColumn("d", F.col("c") > 0), "t", "d", "e").select("time", "at_risk", "events", "hazard"), 9, "hazard")


@query(
    f"""{_SPANS}, d AS (SELECT t, count(*) FILTER (c > 0) AS d, count(*) FILTER (c = 1) AS d1, count(*) FILTER (c = 2) AS d2, count(*) AS l FROM u GROUP BY 1), r AS (SELECT *, sum(l) OVER (ORDER BY t DESC) AS n FROM d),
    s AS (SELECT *, coalesce(product(1 - d / n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS s FROM r WHERE d > 0)
    SELECT t AS time, 1 AS cause, round(sum(s * d1 / n) OVER (ORDER BY t), 9) AS incidence FROM s UNION ALL SELECT t, 2, round(sum(s * d2 / n) OVER (ORDER BY t), 9) FROM s""",
    "events",
)
def cumulative_incidence(events_):
    return _rounded(survival.cumulative_incidence(_spans(events_).withColumn("c", F.expr("nullif(c, 0)")), "t", "c", [1, 2]), 9, "incidence")


# A fit by steps has no SQL; tests hold it against brute force.
@query(None, "events")
def cox(events_):
    return survival.cox(_spans(events_).withColumns({"d": F.col("c") > 0, "low": F.col("e").cast("double")}), "t", "d", ["g", "low"])


@query(
    f"""{_SPANS}, d AS (SELECT t, count(*) FILTER (g = 0 AND c > 0) AS da, count(*) FILTER (g = 1 AND c > 0) AS db, count(*) FILTER (g = 0) AS la, count(*) FILTER (g = 1) AS lb FROM u GROUP BY 1),
    r AS (SELECT t, da, da + db AS d, sum(la) OVER w AS na, sum(lb) OVER w AS nb FROM d WINDOW w AS (ORDER BY t DESC)),
    v AS (SELECT sum(da) AS o, sum(d * na / (na + nb)) AS e, sum(CASE WHEN na + nb > 1 THEN d * na * nb * (na + nb - d) / ((na + nb) ** 2 * (na + nb - 1)) ELSE 0 END) AS v FROM r)
    SELECT round((o - e) ** 2 / v, 6) AS chi2, CAST(o AS DOUBLE) AS observed, round(e, 6) AS expected FROM v""",
    "events",
)
def log_rank(events_):
    return _rounded(stats.log_rank(_spans(events_).withColumn("d", F.col("c") > 0), "t", "d", "g").select("chi2", "observed", "expected"), 6, "chi2", "expected")


# --- series and signals


_HOURS = "WITH h AS (SELECT date_trunc('hour', ts) AS t, count(*)::DOUBLE AS v FROM events GROUP BY 1), s AS (SELECT date_diff('hour', (SELECT min(t) FROM h), t) AS i, v FROM h)"


def _hours(events_: DataFrame) -> DataFrame:
    h = events_.groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    first = h.agg(F.min("t").alias("a"))
    return h.crossJoin(F.broadcast(first)).select("t", "v", F.expr("(unix_timestamp(t) - unix_timestamp(a)) div 3600").alias("i"))


@query(
    f"""{_HOURS} SELECT CAST(k AS INTEGER) AS k, round(any_value(CASE WHEN k IN (0, 360) THEN 1 ELSE 2 END) * (sum(v * cos(2 * pi() * ((i * k) % 720) / 720)) ** 2 + sum(v * sin(2 * pi() * ((i * k) % 720) / 720)) ** 2) / 720, 4) AS power
    FROM s, (SELECT unnest([0, 1, 2, 7, 30, 60]) AS k) WHERE i < 720 GROUP BY k""",
    "events",
)
def periodogram(events_):
    return _rounded(signals.periodogram(_hours(events_).filter("i < 720"), "i", "v", [0, 1, 2, 7, 30, 60], 720), 4, "power")


@query(
    f"""{_HOURS}, p AS (SELECT s.i - g.g * 12 AS i, g.g, v FROM s JOIN range(10000) g(g) ON s.i >= g.g * 12 AND s.i < g.g * 12 + 24), m AS (SELECT g, avg(v) AS m FROM p GROUP BY 1 HAVING count(*) = 24),
    x AS (SELECT g, i, (v - m) * (0.5 - 0.5 * cos(2 * pi() * i / 24)) AS x FROM p JOIN m USING (g)),
    d AS (SELECT g, k, 2 * (sum(x * cos(2 * pi() * i * k / 24)) ** 2 + sum(x * sin(2 * pi() * i * k / 24)) ** 2) / (24 * 0.375) AS d FROM x, (SELECT unnest([1, 2, 5]) AS k) GROUP BY 1, 2)
    SELECT CAST(k AS INTEGER) AS k, round(avg(d), 6) AS power FROM d GROUP BY k""",
    "events",
)
def welch_spectrum(events_):
    return _rounded(signals.welch(_hours(events_), "i", "v", [1, 2, 5], 24), 6, "power")


@query(
    f"""{_HOURS}, c AS (SELECT i, v - avg(v) OVER () AS c FROM s), r AS (SELECT sum(c * l1) / sum(c * c) AS r1, sum(c * l2) / sum(c * c) AS r2 FROM (SELECT c, lag(c) OVER (ORDER BY i) AS l1, lag(c, 2) OVER (ORDER BY i) AS l2 FROM c))
    SELECT 1 AS lag, round(r1, 9) AS pacf FROM r UNION ALL SELECT 2, round((r2 - r1 * r1) / (1 - r1 * r1), 9) FROM r""",
    "events",
)
def pacf(events_):
    return _rounded(signals.pacf(_hours(events_), "t", "v", 2), 9, "pacf")


@query(f"{_HOURS}, e AS (SELECT v, lag(v, 24) OVER (ORDER BY i) AS f, lag(v) OVER (ORDER BY i) AS n FROM s) SELECT count(f) AS n, round(avg(abs(v - f)) / avg(abs(v - n)), 9) AS mase FROM e", "events")
def scaled_error(events_):
    return _rounded(signals.scaled_error(timeseries.seasonal_naive(_hours(events_), "t", "v", 24), "t", "v", "seasonal"), 9, "mase")


@query(
    f"{_HOURS}, e AS (SELECT v, lag(v) OVER (ORDER BY i) AS f FROM s) SELECT count(*) AS n, round(avg(abs(v - f)), 9) AS mae, round(sqrt(avg((v - f) ** 2)), 9) AS rmse, round(1 - sum((v - f) ** 2) / (var_pop(v) * count(*)), 9) AS r2 FROM e WHERE f IS NOT NULL",
    "events",
)
def forecast_errors(events_):
    return _rounded(timeseries.forecast_errors(timeseries.seasonal_naive(_hours(events_), "t", "v", 24), "v", "naive"), 9, "mae", "rmse", "r2")


# --- monitoring


_SCORED = "(SELECT event_id, user_id % 4 AS g, (event_type = 'error')::INTEGER AS y, least(value / 100, 1) AS s FROM events)"


def _scored(events_: DataFrame) -> DataFrame:
    return events_.select("event_id", (F.col("user_id") % 4).alias("g"), (F.col("event_type") == "error").cast("int").alias("y"), F.least(F.col("value") / 100, F.lit(1.0)).alias("s"))


@query(
    f"""WITH e AS {_SCORED}, c AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM e GROUP BY 1), r AS (SELECT p, n, p * (sum(n) OVER (ORDER BY s) - n / 2) AS w FROM c)
    SELECT count(*) FILTER (y = 1 AND s >= 0.3) AS tp, count(*) FILTER (y = 0 AND s >= 0.3) AS fp, count(*) FILTER (y = 1 AND s < 0.3) AS fn, count(*) FILTER (y = 0 AND s < 0.3) AS tn, round(avg((s - y) ** 2), 9) AS brier, (SELECT round(sum(w) / (sum(p) * sum(n)), 9) FROM r) AS roc_auc FROM e""",
    "events",
)
def binary_metrics(events_):
    return _rounded(monitor.binary_metrics(_scored(events_), "y", "s", 0.3).select("tp", "fp", "fn", "tn", "brier", "roc_auc"), 9, "brier", "roc_auc")


@query(f"SELECT CAST(least(9, floor(s * 10)) AS BIGINT) AS bin, count(*) AS n, round(avg(s), 9) AS confidence, round(avg(y), 9) AS frequency FROM {_SCORED} GROUP BY 1", "events")
def calibration(events_):
    return _rounded(monitor.calibration(_scored(events_), "y", "s"), 9, "confidence", "frequency")


@query(f"SELECT g, count(*) AS n, round(avg((y = (s > 0.3)::INTEGER)::INTEGER), 9) AS accuracy, round(avg((s > 0.3)::INTEGER), 9) AS selection_rate, round(avg((s > 0.3)::INTEGER) FILTER (y = 1), 9) AS true_positive_rate FROM {_SCORED} GROUP BY 1", "events")
def fairness_slices(events_):
    return _rounded(monitor.slices(_scored(events_).withColumn("p", (F.col("s") > 0.3).cast("int")), ["g"], "y", "p"), 9, "accuracy", "selection_rate", "true_positive_rate")


@query(f"WITH e AS (SELECT abs(y - s) AS r, row_number() OVER (ORDER BY abs(y - s)) AS k, count(*) OVER () AS n FROM {_SCORED}) SELECT round(r, 9) AS half_width FROM e WHERE k = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT))", "events")
def conformal_width(events_):
    return _rounded(monitor.conformal_width(_scored(events_), "y", "s"), 9, "half_width")


@query(
    """WITH u AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT count(DISTINCT user_id) AS t FROM events), n AS (SELECT event_type, count(*) AS n FROM u GROUP BY 1),
    p AS (SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY 1, 2)
    SELECT a, b, round(p.n / t, 9) AS support, round(p.n / x.n, 9) AS confidence, round(p.n / x.n / (y.n / t), 9) AS lift FROM t, p JOIN n x ON x.event_type = a JOIN n y ON y.event_type = b WHERE p.n >= 0.1 * t AND x.n >= 0.1 * t AND y.n >= 0.1 * t""",
    "events",
)
def association_rules(events_):
    sets = events.frequent_sets(events_, "user_id", "event_type", 0.1, 2)
    found = events.rules(sets, events_.select("user_id").distinct().count(), 0.0)
    one = found.select(F.col("antecedent")[0].alias("a"), F.col("consequent")[0].alias("b"), "support", "confidence", "lift")
    return _rounded(one, 9, "support", "confidence", "lift")


@query(
    """WITH r AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS n, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS steps, CAST(sum((n IS NOT NULL AND a || '>' || n NOT IN ('view>click', 'click>view', 'click>purchase'))::INTEGER + (b IS NULL AND a <> 'view')::INTEGER + (n IS NULL AND a <> 'purchase')::INTEGER) AS BIGINT) AS broken FROM r GROUP BY 1""",
    "events",
)
def conformance(events_):
    return events.conformance(events_, "user_id", "event_type", ["ts", "event_id"], ["view"], [("view", "click"), ("click", "view"), ("click", "purchase")], ["purchase"]).select("user_id", "steps", "broken")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM (SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.05) GROUP BY 1, 2 HAVING count(*) > 1", "lineitem")
def duplicate_groups(lineitem):
    rows = lineitem.select("l_orderkey", "l_linenumber")
    return cleaning.duplicate_groups(rows.unionByName(lineitem.filter("l_tax > 0.05").select(*rows.columns)), ["l_orderkey", "l_linenumber"])

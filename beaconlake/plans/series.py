"""Queries of daily series and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import portfolio as P
from ..operators import series as S
from . import adapters as A
from .surveys import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
ACTION = "1998-06-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each return flag: quantity by ship date."""
    return A.load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v"))


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))


DAILY = "WITH s AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
TYPES = "WITH s AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY ALL)"


@query(TYPES + " SELECT series_id, d, round(v, 4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS r FROM s) WHERE r > 3")
def ser_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trim(by_type(spark, sf_dir), 3).withColumn("v", F.round("v", 4))


@query("SELECT n_name AS site, CAST(sum(o.k) AS BIGINT) AS clicks, CAST(sum(o.p) AS BIGINT) AS impressions, round(avg(o.p % 50), 6) AS position, round(sum(o.k) * 100.0 / sum(o.p), 6) AS ctr FROM (SELECT o_custkey, o_orderkey % 7 AS k, 1 + o_orderkey % 97 AS p FROM orders) o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def ser_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey % 7 as clicks", "1 + o_orderkey % 97 as impressions", "(1 + o_orderkey % 97) % 50 as position")
    sites = o.join(A.load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(A.load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(S.totals(sites.withColumnRenamed("n_name", "site"), ["site"]), "position", "ctr")


@query(TYPES + " SELECT series_id, week, min(d) AS start, count(*) AS days, round(sum(v), 4) AS v FROM (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY d) - 1) // 7 AS week FROM s) GROUP BY series_id, week")
def ser_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weekly(by_type(spark, sf_dir)).withColumn("v", F.round("v", 4))


_MOVERS = "WITH b AS (SELECT user_id, sum(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), a AS (SELECT user_id, sum(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1), m AS (SELECT user_id, round(coalesce(b.v, 0), 4) AS before, round(coalesce(a.v, 0), 4) AS after, round(coalesce(a.v, 0) - coalesce(b.v, 0), 4) AS change FROM b FULL JOIN a USING (user_id))"


@query(_MOVERS + " SELECT * FROM m")
def ser_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.load(spark, sf_dir, "events").withColumn("v", F.col("value"))
    out = S.movers(e.where("ts < timestamp_ntz'2024-01-16'"), e.where("ts >= timestamp_ntz'2024-01-16'"), "user_id")
    return out.withColumns({c: F.round(c, 4) for c in ("before", "after", "change")})


@query(_MOVERS + " SELECT * FROM (SELECT *, row_number() OVER (ORDER BY change, user_id) AS rank, 'down' AS direction FROM m UNION ALL SELECT *, row_number() OVER (ORDER BY change DESC, user_id), 'up' FROM m) WHERE rank <= 10")
def ser_top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_movers(ser_movers(spark, sf_dir), "user_id", 10).withColumn("rank", F.col("rank").cast("long"))


@query(DAILY + " SELECT count(*) FILTER (t.d IS NULL OR c.d IS NULL) AS gaps FROM (SELECT d FROM s WHERE series_id = 'R') t FULL JOIN (SELECT d FROM s WHERE series_id = 'N') c ON t.d = c.d")
def ser_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily(spark, sf_dir)
    return S.gaps(s.where("series_id = 'R'"), s.where("series_id = 'N'"))


@query(TYPES + ", x AS (SELECT *, CASE WHEN d < DATE '2024-01-16' THEN 0 WHEN d >= DATE '2024-01-16' + 2 THEN 1 END AS side FROM s) SELECT series_id, count(*) FILTER (side = 0) AS days_before, count(*) FILTER (side = 1) AS days_after, round(sum(v) FILTER (side = 0), 4) AS total_before, round(sum(v) FILTER (side = 1), 4) AS total_after, round(avg(v) FILTER (side = 0), 4) AS mean_before, round(avg(v) FILTER (side = 1), 4) AS mean_after, min(d) FILTER (side = 0) AS start, max(d) FILTER (side = 1) AS end FROM x GROUP BY 1")
def ser_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.describe(by_type(spark, sf_dir), "2024-01-16", 2).drop("pct_change")
    return out.withColumns({c: F.round(c, 4) for c in ("total_before", "total_after", "mean_before", "mean_after")})


@query(TYPES + " SELECT series_id, count(*) AS days FROM s WHERE d BETWEEN DATE '2024-01-03' AND DATE '2024-01-10' GROUP BY 1")
def ser_window_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the window before 11 to 18 January."""
    return S.between(by_type(spark, sf_dir), *S.window_before("2024-01-11", "2024-01-18")).groupBy("series_id").agg(F.count("*").alias("days"))


@query(DAILY + """, x AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id) AS x FROM s),
p AS (SELECT series_id, d, count(*) OVER a AS n1, sum(x) OVER a AS s1, sum(x * x) OVER a AS q1, count(*) OVER w AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM x WINDOW w AS (PARTITION BY series_id), a AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT series_id, d, round(abs(s1 / n1 - (s - s1) / (n - n1)) / sqrt((q1 - s1 * s1 / n1) / (n1 - 1) / n1 + ((q - q1) - (s - s1) ** 2 / (n - n1)) / (n - n1 - 1) / (n - n1)), 9) AS stat FROM p WHERE n1 >= 7 AND n - n1 >= 7)
SELECT series_id, d, round(stat, 4) AS stat FROM t QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY stat DESC, d) = 1 AND stat >= 3""")
def ser_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.changepoint(daily(spark, sf_dir)).withColumn("stat", F.round("stat", 4))


def _did(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily(spark, sf_dir)
    return S.difference(s.where("series_id = 'R'"), s.where("series_id = 'N'"), ACTION, 3)


_DID = DAILY + f""", x AS (SELECT *, CASE WHEN d < DATE '{ACTION}' THEN 0 WHEN d >= DATE '{ACTION}' + 3 THEN 1 END AS side FROM s), c AS (SELECT * FROM x WHERE series_id = 'N'),
b AS (SELECT t.d, t.side, t.v AS t, coalesce(c.v, 0) AS f FROM x t LEFT JOIN c ON t.d = c.d WHERE t.series_id = 'R'),
o AS (SELECT avg(v) FILTER (side = 0) AS c0, avg(v) FILTER (side = 1) AS c1 FROM c),
m AS (SELECT avg(t) FILTER (side = 0) AS t0, avg(t) FILTER (side = 1) AS t1, avg(f) FILTER (side = 0) AS f0, avg(f) FILTER (side = 1) AS f1, count(*) FILTER (side = 0) AS days_before, count(*) FILTER (side = 1) AS days_after, sum(t) FILTER (side = 0) AS total_before, sum(t) FILTER (side = 1) AS total_after FROM b),
p AS (SELECT *, round((t1 - t0) * 100 / t0, 1) AS treated_pct, round((c1 - c0) * 100 / c0, 1) AS control_pct, (t1 - t0 / c0 * f1) - (t0 - t0 / c0 * f0) AS per_day FROM m, o)"""


@query(_DID + " SELECT days_before, days_after, treated_pct, control_pct, round(treated_pct - control_pct, 1) AS points, round(per_day, 4) AS per_day FROM p")
def ser_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _did(spark, sf_dir).select("days_before", "days_after", "treated_pct", "control_pct", "points", F.round("per_day", 4).alias("per_day"))


@query(_DID + " SELECT CASE WHEN days_before < 14 OR days_after < 14 OR least(total_before, total_after) < 50 THEN 'insufficient_data' WHEN control_pct IS NULL THEN 'no_control' WHEN abs(round(treated_pct - control_pct, 1)) >= 5 THEN 'consistent_with_the_action' WHEN treated_pct * control_pct > 0 AND abs(control_pct) >= 20 THEN 'market_wide_movement' ELSE 'no_detectable_effect' END AS verdict FROM p")
def ser_impact_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the p value, which is ser_permutation's."""
    return S.verdict(_did(spark, sf_dir)).select("verdict")


@query()
def ser_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p of each user's daily values against all views: a series for each of up to a thousand users and more, of different lengths."""
    e = A.load(spark, sf_dir, "events")
    users = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"), F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))
    return S.permutation_p(users, by_type(spark, sf_dir).where("series_id = 'view'"), "2024-01-16")


_SITES = "WITH o AS (SELECT n_name AS site, o_totalprice AS v, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END AS now FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), t AS (SELECT site, round(sum(v) FILTER (now = 0), 2) AS before, round(sum(v) FILTER (now = 1), 2) AS after FROM o GROUP BY site), p AS (SELECT *, round((after - before) * 100 / before, 1) AS pct FROM t)"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders").join(A.load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(A.load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    now = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    t = o.groupBy(F.col("n_name").alias("site")).agg(F.round(F.sum(F.when(~now, F.col("o_totalprice"))), 2).alias("before"), F.round(F.sum(F.when(now, F.col("o_totalprice"))), 2).alias("after"))
    return t.withColumn("pct", F.round(F.try_divide((F.col("after") - F.col("before")) * 100, F.col("before")), 1))


_TONED = _SITES + ", y AS (SELECT n_name AS site, before, after, pct, CASE WHEN pct IS NULL THEN 'none' WHEN pct >= 10 THEN 'good' WHEN pct <= -15 THEN 'bad' WHEN pct <= -5 THEN 'warn' ELSE 'flat' END AS tone FROM (SELECT n_name FROM nation UNION ALL SELECT 'nowhere') LEFT JOIN p ON site = n_name)"


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation as a site, and one without data."""
    sites = A.load(spark, sf_dir, "nation").select(F.col("n_name").alias("site")).unionByName(spark.createDataFrame([("nowhere",)], "site string"))
    return P.changes(sites, _sites(spark, sf_dir).drop("pct"))


@query(_TONED + " SELECT * FROM y")
def port_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir)


@query(_TONED + " SELECT count(*) AS sites, count(*) FILTER (pct > 0) AS up, count(*) FILTER (pct < 0) AS down, count(*) FILTER (after IS NULL) AS no_data, round(sum(after), 2) AS after, round(sum(before), 2) AS before FROM y")
def port_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rollup(_changed(spark, sf_dir))


@query(_TONED + ", n AS (SELECT n_name AS site, count(*) AS actions FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' GROUP BY 1) SELECT site, pct, CASE WHEN pct <= -15 THEN 'high' ELSE 'medium' END AS severity, coalesce(actions, 0) AS actions FROM (SELECT * FROM y WHERE pct <= -5 ORDER BY pct, site LIMIT 3) LEFT JOIN n USING (site)")
def port_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.findings(_changed(spark, sf_dir), port_actions(spark, sf_dir))


@query("SELECT o_orderkey AS action_id, n_name AS site, CAST(o_orderdate AS DATE) AS d, o_orderstatus = 'O' AS planned FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE (o_orderstatus <> 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31') OR (o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01')")
def port_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders").join(A.load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(A.load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lower(F.substring("n_name", 1, 1)), F.substring("n_name", 2, 100), F.lit(" !"))  # as an agency may write it
    rows = o.select(F.col("o_orderkey").alias("action_id"), name.alias("site"), F.to_date("o_orderdate").alias("d"), (F.col("o_orderstatus") == "O").alias("planned"))
    sites = A.load(spark, sf_dir, "nation").select(F.col("n_name").alias("site"), F.array("n_name", F.lit("")).alias("names"))
    return P.actions(rows, sites, "1996-01-01", "1996-03-31")

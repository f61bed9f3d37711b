"""Queries over dated series: growth, windows, correlation, alignment and chart windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.operators import series as S
from ledgerlake.session import table

FACT = """fact AS (SELECT n_name AS company, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS observed_at, round(sum(o_totalprice), 2) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
DAILY = """daily AS (SELECT event_type AS series, CAST(ts AS DATE) AS observed_at, round(avg(value), 8) AS value FROM events GROUP BY ALL)"""


def fact(spark, sf):
    return (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("company"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("observed_at")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


def daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("observed_at")).agg(F.round(F.avg("value"), 8).alias("value"))


@query("w1_quarter_growth", f"WITH {FACT} SELECT company, observed_at, round((value / nullif(lag(value) OVER w, 0) - 1) * 100, 6) AS growth FROM fact WINDOW w AS (PARTITION BY company ORDER BY observed_at)")
def w1(spark, sf):
    return S.consecutive_growth(fact(spark, sf), ["company"], "observed_at").select("company", "observed_at", F.round("growth", 6).alias("growth"))


@query("w3_j10_year_growth_tolerance", f"""WITH {FACT}
SELECT c.company, c.observed_at, p.observed_at AS base_at, round((c.value / p.value - 1) * 100, 6) AS growth
FROM fact c JOIN fact p ON c.company = p.company AND year(p.observed_at) = year(CAST(c.observed_at - INTERVAL 1 YEAR AS DATE)) AND abs(date_diff('day', p.observed_at, CAST(c.observed_at - INTERVAL 1 YEAR AS DATE))) <= 7 AND p.value <> 0
QUALIFY row_number() OVER (PARTITION BY c.company, c.observed_at ORDER BY abs(date_diff('day', p.observed_at, CAST(c.observed_at - INTERVAL 1 YEAR AS DATE))), p.observed_at) = 1""")
def w3(spark, sf):
    return S.year_over_year_dated(fact(spark, sf), ["company"]).select("company", "observed_at", "base_at", F.round("growth", 6).alias("growth"))


@query("w4_w6_w7_endpoints", f"""WITH {FACT}, e AS (SELECT company, min_by(value, observed_at) AS first_value, max_by(value, observed_at) AS last_value, min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS n_points FROM fact GROUP BY company)
SELECT company, n_points, round(last_value - first_value, 4) AS absolute_change, round((last_value / nullif(first_value, 0) - 1) * 100, 6) AS percentage_change,
CASE WHEN first_value > 0 AND last_value >= 0 AND last_at > first_at THEN round((pow(last_value / first_value, 1 / (date_diff('day', first_at, last_at) / 365.25)) - 1) * 100, 6) END AS cagr FROM e""")
def w4(spark, sf):
    e = S.endpoints(fact(spark, sf), ["company"], "observed_at")
    years = F.datediff("last_at", "first_at") / 365.25
    return e.select("company", "n_points", F.round(F.col("last_value") - F.col("first_value"), 4).alias("absolute_change"), F.round(S.growth_pct(F.col("last_value"), F.col("first_value")), 6).alias("percentage_change"), F.when(years > 0, F.round(S.cagr(F.col("first_value"), F.col("last_value"), F.nullif(years, F.lit(0.0))), 6)).alias("cagr"))


@query("w5_margin", """SELECT l_returnflag AS company, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0) * 100, 6) AS margin FROM lineitem GROUP BY ALL""")
def w5(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("company")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("n"), F.sum("l_extendedprice").alias("d"))
    return sums.select("company", F.round(S.margin(F.col("n"), F.col("d")), 6).alias("margin"))


@query("w8_rolling_average", f"WITH {FACT} SELECT company, observed_at, round(avg(value) OVER w, 4) AS rolling_avg FROM fact WINDOW w AS (PARTITION BY company ORDER BY observed_at ROWS 3 PRECEDING) QUALIFY count(*) OVER w = 4")
def w8(spark, sf):
    return S.rolling_average(fact(spark, sf), ["company"], "observed_at", 4).select("company", "observed_at", F.round("rolling_avg", 4).alias("rolling_avg"))


@query("w9_normalised_index", f"WITH {FACT} SELECT company, observed_at, round(value / nullif(first_value(value) OVER (PARTITION BY company ORDER BY observed_at), 0) * 100, 6) AS index_value FROM fact")
def w9(spark, sf):
    return S.normalised_index(fact(spark, sf), ["company"], "observed_at").select("company", "observed_at", F.round("index_value", 6).alias("index_value"))


@query("a7_correlation", f"""WITH {DAILY} SELECT a.series AS x, b.series AS y, count(*) AS n_pairs, round(corr(a.value, b.value), 6) AS correlation FROM daily a JOIN daily b ON a.observed_at = b.observed_at AND a.series < b.series GROUP BY ALL""")
def a7(spark, sf):
    d = daily(spark, sf)
    pairs = d.select("observed_at", F.col("series").alias("x"), F.col("value").alias("xv")).join(d.select("observed_at", F.col("series").alias("y"), F.col("value").alias("yv")), "observed_at").filter("x < y")
    return S.correlation(pairs, ["x", "y"], "xv", "yv").select("x", "y", "n_pairs", F.round("correlation", 6).alias("correlation"))


@query("j8_asof_alignment", f"""WITH {DAILY}, p AS (SELECT observed_at, value FROM daily WHERE series = 'purchase' AND day(observed_at) % 2 = 0), v AS (SELECT event_type AS k, ts AS at, event_id FROM events WHERE event_type = 'error')
SELECT v.event_id, p.observed_at AS known_at, round(p.value, 6) AS value FROM v ASOF LEFT JOIN p ON CAST(v.at AS DATE) >= p.observed_at""")
def j8(spark, sf):
    p = daily(spark, sf).filter((F.col("series") == "purchase") & (F.dayofmonth("observed_at") % 2 == 0)).select(F.col("observed_at").alias("known_at"), "value")
    v = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", F.col("ts").cast("date").alias("at"))
    return S.asof_backward(v, p, "at", "known_at", ["value"], []).select("event_id", "known_at", F.round("value", 6).alias("value"))


@query("j9_u2_date_intersection", f"""WITH {DAILY} SELECT a.observed_at, round(a.value, 6) AS purchase, round(b.value, 6) AS signup, round(c.value, 6) AS view FROM daily a JOIN daily b USING (observed_at) JOIN daily c USING (observed_at) WHERE a.series = 'purchase' AND b.series = 'signup' AND c.series = 'view'""")
def j9(spark, sf):
    d = daily(spark, sf)
    got = S.date_intersection({s: d.filter(F.col("series") == s) for s in ("purchase", "signup", "view")})
    return got.select("observed_at", *[F.round(s, 6).alias(s) for s in ("purchase", "signup", "view")])


@query("w14_latest_points", f"WITH {FACT} SELECT company, observed_at, value FROM fact QUALIFY row_number() OVER (PARTITION BY company ORDER BY observed_at DESC) <= 8")
def w14(spark, sf):
    return S.latest_points(fact(spark, sf), ["company"], "observed_at").select("company", "observed_at", "value")


@query("w15_same_period_pairs", """WITH q AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders) SELECT o_custkey AS company, bool_or(n > 1) AS has_pair FROM (SELECT o_custkey, q, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL""")
def w15(spark, sf):
    q = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).distinct()
    return q.groupBy("o_custkey", "q").agg((F.count(F.lit(1)) > 1).alias("twice")).groupBy(F.col("o_custkey").alias("company")).agg(F.bool_or("twice").alias("has_pair"))

"""The end-to-end question: revenue growth beside the latest macro value known at each date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ledgerlake.catalogue import query
from ledgerlake.operators.series import asof_backward, year_over_year_dated
from ledgerlake.session import table

FLAGSHIP_SQL = """
WITH fact AS (
  SELECT n_name AS company, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS observed_at, round(sum(o_totalprice), 2) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
macro AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS macro_at, round(avg(l_discount), 8) AS macro_value FROM lineitem GROUP BY ALL),
growth AS (
  SELECT c.company, c.observed_at, round((c.value / p.value - 1) * 100, 6) AS growth_pct
  FROM fact c JOIN fact p ON c.company = p.company AND p.observed_at = CAST(c.observed_at - INTERVAL 1 YEAR AS DATE) AND p.value <> 0),
aligned AS (
  SELECT g.company, g.observed_at, g.growth_pct, m.macro_at, round(m.macro_value, 6) AS macro_value
  FROM growth g ASOF JOIN macro m ON g.observed_at >= m.macro_at)
SELECT company, observed_at, growth_pct, macro_at, macro_value FROM aligned
QUALIFY row_number() OVER (PARTITION BY company ORDER BY observed_at DESC) <= 8
"""


@query("flagship_growth_macro_chart", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fact = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("company"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("observed_at"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )
    growth = year_over_year_dated(fact, keys=["company"], tolerance_days=0).select("company", "observed_at", F.round("growth", 6).alias("growth_pct"))
    macro = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("macro_at"))
        .agg(F.round(F.avg("l_discount"), 8).alias("macro_value"))
    )
    aligned = asof_backward(growth, macro, left_on="observed_at", right_on="macro_at", values=["macro_value"], keys=[])
    latest = W.partitionBy("company").orderBy(F.desc("observed_at"))
    return (
        aligned.filter(F.col("macro_at").isNotNull())
        .withColumn("rn", F.row_number().over(latest))
        .filter("rn <= 8")
        .select("company", "observed_at", "growth_pct", "macro_at", F.round("macro_value", 6).alias("macro_value"))
    )

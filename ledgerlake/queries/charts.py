"""Queries over charts made of orders: a chart a customer group, a series a priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.operators import charts as G
from ledgerlake.session import table

P = """r AS (SELECT o_custkey % 20 AS chart_id, left(o_orderpriority, 1) AS series, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS observed_at, o_orderkey AS position, CASE WHEN o_orderkey % 9 > 0 THEN round(o_totalprice, 2) END AS value, 'u' || o_orderkey % 4 AS source_url FROM orders),
l AS (SELECT chart_id, series, observed_at, max_by(value, position) AS value, max_by(source_url, position) AS u FROM r WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT chart_id, count(DISTINCT series) AS wanted FROM r GROUP BY chart_id),
p AS (SELECT l.chart_id, observed_at, count(*) AS n, sum(value) AS total FROM l JOIN w ON w.chart_id = l.chart_id GROUP BY l.chart_id, observed_at, wanted HAVING count(*) = wanted)"""


def rows(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("chart_id"), F.left("o_orderpriority", F.lit(1)).alias("series"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("observed_at"),
        F.when(key % 9 > 0, F.round("o_totalprice", 2)).alias("value"), F.concat(F.lit("u"), key % 4).alias("source_url"), key.alias("position"), F.when((F.col("o_custkey") % 20 == 3) & (key % 8 == 0), "EUR").otherwise("USD").alias("unit"),
    )


@query("g24_series_points", f"WITH {P} SELECT chart_id, observed_at, n AS n_values, round(total, 2) AS total FROM p")
def g24(spark, sf):
    return G.series_points(rows(spark, sf)).select("chart_id", "observed_at", F.size("values").cast("long").alias("n_values"), F.round(F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("g1_dataset_faults", f"""WITH {P}, s AS (SELECT DISTINCT chart_id, series FROM r), q AS (SELECT chart_id FROM p GROUP BY chart_id)
SELECT DISTINCT chart_id, 'no_points' AS fault FROM s WHERE chart_id NOT IN (SELECT chart_id FROM q) UNION ALL SELECT chart_id, 'repeated_series' FROM (SELECT DISTINCT chart_id FROM s) WHERE chart_id = 5 UNION ALL SELECT DISTINCT chart_id, 'blank_field' FROM s WHERE chart_id = 6
UNION ALL SELECT chart_id, 'incomplete_point' FROM q WHERE chart_id = 7 UNION ALL SELECT chart_id, 'repeated_date' FROM q WHERE chart_id = 8 UNION ALL SELECT chart_id, 'no_lineage' FROM q WHERE chart_id = 9""")
def g1(spark, sf):
    """Chart 5 has a series twice, 6 a blank unit, 7 a series without points, 8 its dates twice, 9 no sources."""
    chart = F.col("chart_id")
    series = rows(spark, sf).select("chart_id", "series").distinct().withColumns({"label": F.col("series"), "unit": F.when(chart == 6, " ").otherwise("USD")})
    series = series.unionByName(series.filter(chart == 5)).unionByName(series.filter(chart == 7).withColumn("series", F.lit("more")).distinct().dropDuplicates(["chart_id"]))
    points = G.series_points(rows(spark, sf))
    points = points.unionByName(points.filter(chart == 8)).withColumn("source_urls", F.when(chart == 9, F.array().cast("array<string>")).otherwise(F.col("source_urls")))
    return G.dataset_faults(series, points)


@query("g3_mixed_units", "SELECT o_custkey % 20 AS chart_id, left(o_orderpriority, 1) AS series, count(DISTINCT CASE WHEN o_custkey % 20 = 3 AND o_orderkey % 8 = 0 THEN 'EUR' ELSE 'USD' END) AS n_units FROM orders GROUP BY ALL HAVING count(DISTINCT CASE WHEN o_custkey % 20 = 3 AND o_orderkey % 8 = 0 THEN 'EUR' ELSE 'USD' END) > 1")
def g3(spark, sf):
    return G.mixed_units(rows(spark, sf))


@query("g2_g4_specifications", f"WITH {P} SELECT chart_id, count(*) AS n_points, CASE WHEN count(*) < 3 THEN 'partial' ELSE 'complete' END AS status, min(observed_at) AS first_day FROM p GROUP BY chart_id")
def g2(spark, sf):
    points = G.series_points(rows(spark, sf))
    series = rows(spark, sf).select("chart_id", "series", F.col("series").alias("label"), F.lit("USD").alias("unit")).distinct()
    made = G.specifications(series, points, "line", "Orders").select("chart_id", F.col("data")[0]["observed_at"].alias("first_day"))
    return G.chart_status(points, "line", 5).join(made, "chart_id")

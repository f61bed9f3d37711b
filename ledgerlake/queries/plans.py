"""Research plans run end to end over quarterly and annual totals of orders and daily totals of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.catalogue import query
from ledgerlake.plans.calculations import runners
from ledgerlake.plans.execution import run_plan
from ledgerlake.plans.research import Branch, Plan
from ledgerlake.session import table

Q = """q AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS s, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS e, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
y AS (SELECT CAST(make_date(year(o_orderdate), 12, 31) AS DATE) AS e, sum(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY year(o_orderdate)),
d AS (SELECT CAST(ts AS DATE) AS e, event_type, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL)"""
OUT = "'Orders revenue ' || {e} AS label, {e} AS observed_at, round({v}, 6) AS value, '{unit}' AS unit"


def _facts(rows: DataFrame, kind: str, metric: str = "revenue", value: str = "v") -> DataFrame:
    period = F.concat(F.lit("Q"), F.quarter("e")) if kind == "quarter" else F.lit("FY")
    return rows.select(
        F.xxhash64("e", F.lit(metric)).alias("fact_id"), F.lit(1).alias("company_id"), F.lit("Orders").alias("company_name"), F.lit(metric).alias("metric"), F.col("s").alias("period_start"), F.col("e").alias("period_end"),
        F.lit(kind).alias("period_type"), F.lit("USD").alias("unit"), period.alias("fiscal_period"), F.col(value).cast("double").alias("value"), F.col("e").alias("filed_date"), F.lit("a").alias("accession_number"),
    )


def facts(spark, sf, kind: str) -> DataFrame:
    """The revenue of all orders by quarter or year, and by year their number as a second metric."""
    own = table(spark, sf, "orders")
    if kind == "quarter":
        start = F.date_trunc("quarter", "o_orderdate").cast("date")
        return _facts(own.groupBy(start.alias("s")).agg(F.sum("o_totalprice").alias("v")).withColumn("e", F.date_sub(F.add_months("s", 3), 1)), kind)
    by_year = own.groupBy(F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("s")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n")).withColumn("e", F.date_sub(F.add_months("s", 12), 1))
    return _facts(by_year, kind).unionByName(_facts(by_year, kind, "orders", "n"))


def macro(spark, sf) -> DataFrame:
    """Events a day of each type as series."""
    days = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("observed_at")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return days.withColumn("unit", F.lit("events"))


def result(spark, sf, operation: str, sources: list[Branch], **options) -> DataFrame:
    """A plan of the sources and one calculation over them, run; the calculation's rows."""
    plan = Plan((*sources, Branch("out", "calculation", tuple(b.branch_id for b in sources), options={"operation": operation, **options})))

    def of_facts(branch: Branch) -> DataFrame:
        rows = facts(spark, sf, branch.options["kind"]).filter(F.col("metric").isin(*branch.options["metrics"]))
        return rows.filter(F.col("period_end") == F.lit(branch.options["day"]).cast("date")) if "day" in branch.options else rows

    def of_macro(branch: Branch) -> DataFrame:
        return macro(spark, sf).filter(F.col("series_id").isin(*branch.options["series_ids"]))

    results, outcomes = run_plan(plan, runners(plan, of_facts, of_macro))
    if "out" not in results:
        raise ValueError(str(outcomes))
    return results["out"].withColumn("value", F.round("value", 6))


def revenue(kind: str = "quarter", metric: str = "revenue", name: str = "f", **options) -> Branch:
    return Branch(name, "financial_facts", options={"kind": kind, "metrics": (metric,), **options})


@query("g5_g6_quarter_over_quarter", f"WITH {Q}, l AS (SELECT *, lag(v) OVER (ORDER BY e) AS p FROM q) SELECT {OUT.format(e='e', v='(v / p - 1) * 100', unit='percent')} FROM l ORDER BY e DESC LIMIT 1")
def quarter_growth(spark, sf):
    return result(spark, sf, "quarter_over_quarter_growth", [revenue()])


@query("g5_g6_year_over_year", f"WITH {Q} SELECT {OUT.format(e='a.e', v='(a.v / b.v - 1) * 100', unit='percent')} FROM q a JOIN q b ON a.s = b.s + INTERVAL 1 YEAR")
def year_growth(spark, sf):
    return result(spark, sf, "year_over_year_growth", [revenue()])


@query("g5_g6_annual_growth", f"WITH {Q} SELECT {OUT.format(e='a.e', v='(a.v / b.v - 1) * 100', unit='percent')} FROM y a JOIN y b ON year(a.e) = year(b.e) + 1 WHERE year(a.e) BETWEEN 1993 AND 1996 AND year(b.e) >= 1993")
def annual_growth(spark, sf):
    return result(spark, sf, "year_over_year_growth", [revenue("annual", fiscal_years=(1994, 1995, 1996))])


@query("g5_cagr", f"WITH {Q}, z AS (SELECT min_by(v, e) AS a, max_by(v, e) AS b, max(e) AS e FROM y WHERE e <= DATE '2100-01-01') SELECT {OUT.format(e='e', v='(pow(b / a, 1 / 3.0) - 1) * 100', unit='percent')} FROM z")
def cagr(spark, sf):
    return result(spark, sf, "cagr", [revenue("annual")], years=3)


@query("g5_margin", f"WITH {Q} SELECT {OUT.format(e='e', v='v / n * 100', unit='percent')} FROM y WHERE e = DATE '1995-12-31'")
def margin(spark, sf):
    return result(spark, sf, "margin", [revenue("annual", day="1995-12-31"), revenue("annual", "orders", "g", day="1995-12-31")])


@query("g5_absolute_change", f"WITH {Q}, z AS (SELECT min_by(v, e) AS a, max_by(v, e) AS b, max(e) AS e FROM q) SELECT {OUT.format(e='e', v='b - a', unit='USD')} FROM z")
def absolute(spark, sf):
    return result(spark, sf, "absolute_change", [revenue()]).withColumn("value", F.round("value", 2))


@query("g5_percentage_change", f"WITH {Q}, z AS (SELECT min_by(v, e) AS a, max_by(v, e) AS b, max(e) AS e FROM q) SELECT {OUT.format(e='e', v='(b / a - 1) * 100', unit='percent')} FROM z")
def percentage(spark, sf):
    return result(spark, sf, "percentage_change", [revenue()])


M = "'{name} ' || e AS label, e AS observed_at, round({v}, 6) AS value, '{unit}' AS unit"


@query("g5_rolling_average", f"WITH {Q}, z AS (SELECT e, avg(v) OVER w AS a, count(*) OVER w AS n FROM d WHERE event_type = 'click' WINDOW w AS (ORDER BY e ROWS 2 PRECEDING)) SELECT {M.format(name='click', v='a', unit='events')} FROM z WHERE n = 3")
def rolling(spark, sf):
    return result(spark, sf, "rolling_average", [Branch("m", "macro_series", options={"series_ids": ("click",)})], window=3)


@query("g5_normalised_index", f"WITH {Q}, z AS (SELECT e, v, first(v) OVER (ORDER BY e) AS a FROM d WHERE event_type = 'purchase') SELECT {M.format(name='purchase', v='v / a * 50', unit='index')} FROM z")
def index(spark, sf):
    return result(spark, sf, "normalised_index", [Branch("m", "macro_series", options={"series_ids": ("purchase",)})], base=50)


@query("g5_correlation", f"WITH {Q} SELECT 'correlation' AS label, max(a.e) AS observed_at, round(corr(a.v, b.v), 6) AS value, 'coefficient' AS unit FROM d a JOIN d b ON a.e = b.e WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def correlation(spark, sf):
    return result(spark, sf, "correlation", [Branch(x, "macro_series", options={"series_ids": (x,)}) for x in ("click", "purchase")])

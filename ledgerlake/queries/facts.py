"""Queries over facts and macro series, on the orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.operators import facts as X, macro as M
from ledgerlake.operators.filters import retrieval_filters
from ledgerlake.plans.requests import FactRequest, MacroRequest, RetrievalFilters
from ledgerlake.session import table

ROWS = """f AS (SELECT o_orderkey AS fact_id, o_custkey AS company_id, 'revenue' AS metric, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start, CAST(o_orderdate AS DATE) AS period_end,
  CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'quarter' END AS period_type, 'USD' AS unit, 'Q' || quarter(o_orderdate) AS fiscal_period, year(o_orderdate) AS fiscal_year, round(o_totalprice, 2) AS value,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS filed_date, 'acc-' || (o_orderkey % 11) AS accession_number, o_orderstatus = 'P' AS is_amendment FROM orders)"""


def facts(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        key.alias("fact_id"), F.col("o_custkey").alias("company_id"), F.lit("revenue").alias("metric"), F.date_trunc("quarter", day).cast("date").alias("period_start"), day.cast("date").alias("period_end"),
        F.when(key % 3 == 0, "annual").otherwise("quarter").alias("period_type"), F.lit("USD").alias("unit"), F.concat(F.lit("Q"), F.quarter(day)).alias("fiscal_period"), F.year(day).alias("fiscal_year"), F.round("o_totalprice", 2).alias("value"),
        F.when(key % 7 != 0, day.cast("date")).alias("filed_date"), F.concat(F.lit("acc-"), key % 11).alias("accession_number"), (F.col("o_orderstatus") == "P").alias("is_amendment"),
    )


def companies(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"))


def tickers(spark, sf):
    key = F.col("c_custkey")
    mine = table(spark, sf, "customer").select(key.alias("company_id"), F.explode(F.array(F.concat(F.lit("T"), key), F.concat(F.lit("A"), key))).alias("symbol"), (key % 5 != 0).alias("is_primary"))
    return mine.withColumn("valid_to", F.when(mine["company_id"] % 4 == 0, F.lit("2000-01-01").cast("date")))


@query("s6_classify_period", f"""WITH {ROWS} SELECT fact_id, CASE WHEN period_start IS NULL THEN 'instant' WHEN d >= 300 THEN 'annual' WHEN d BETWEEN 70 AND 110 THEN 'quarter' WHEN fiscal_period IN ('Q2', 'Q3', 'Q4') AND d < 300 THEN 'year_to_date' ELSE 'other' END AS kind
FROM (SELECT *, date_diff('day', period_start, period_end) + 1 AS d FROM f)""")
def s6(spark, sf):
    return facts(spark, sf).select("fact_id", X.classify_period(F.col("period_start"), F.col("period_end"), F.col("fiscal_period")).alias("kind"))


@query("p1_t1_a3_j5_fact_query", f"""WITH {ROWS}, cut AS (SELECT f.*, c_name AS company_name FROM f JOIN customer ON company_id = c_custkey WHERE fiscal_year IN (1996, 1997) AND NOT is_amendment ORDER BY company_name, metric, period_end DESC, filed_date DESC NULLS LAST, accession_number DESC NULLS LAST, fact_id DESC LIMIT 500),
t AS (SELECT c_custkey AS company_id, 'A' || c_custkey AS ticker FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0)
SELECT fact_id, company_name, period_end, value, ticker, min(value) OVER w <> max(value) OVER w AS has_conflict FROM cut LEFT JOIN t USING (company_id) WINDOW w AS (PARTITION BY company_id, metric, period_start, period_end, period_type, unit, fiscal_period)""")
def p1(spark, sf):
    got = X.query_facts(facts(spark, sf), companies(spark, sf), tickers(spark, sf), FactRequest(fiscal_years=(1996, 1997), exclude_amendments=True, limit=500))
    return got.select("fact_id", "company_name", "period_end", "value", "ticker", "has_conflict")


@query("j4_ticker_semi_join", f"""WITH {ROWS} SELECT fact_id FROM f WHERE company_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND ('T' || c_custkey) IN ('T7', 'T10', 'T12'))""")
def j4(spark, sf):
    from ledgerlake.operators.filters import fact_filters

    return fact_filters(facts(spark, sf), FactRequest(tickers=("t7", " T10 ", "T12")), tickers(spark, sf)).select("fact_id")


@query("a4_latest_filings", f"""WITH {ROWS} SELECT fact_id FROM f QUALIFY row_number() OVER (PARTITION BY company_id, metric, period_start, period_type, unit, fiscal_period ORDER BY coalesce(filed_date, DATE '0001-01-01') DESC, accession_number DESC, fact_id DESC) = 1""")
def a4(spark, sf):
    return X.latest_filings(facts(spark, sf), ("company_id", "metric", "period_start", "period_type", "unit", "fiscal_period")).select("fact_id")


@query("a5_annual_latest", f"""WITH {ROWS} SELECT company_id, period_end, max(value) FILTER (WHERE true) AS value FROM (SELECT * FROM f WHERE period_type = 'annual' QUALIFY row_number() OVER (PARTITION BY company_id, metric, unit, period_end ORDER BY coalesce(filed_date, DATE '0001-01-01') DESC, accession_number DESC, fact_id DESC) = 1) GROUP BY ALL""")
def a5(spark, sf):
    return X.annual_latest(facts(spark, sf)).select("company_id", "period_end", "value")


@query("g19_readiness", f"""WITH {ROWS}, want AS (SELECT c_custkey AS company_id, 'revenue' AS metric, CASE WHEN c_custkey % 2 = 0 THEN 'growth' ELSE 'value' END AS operation FROM customer)
SELECT company_id, metric, operation, count(fact_id) AS n_facts, CASE WHEN count(fact_id) >= CASE WHEN operation = 'growth' THEN 2 ELSE 1 END THEN 'available' WHEN count(fact_id) > 0 THEN 'partial' ELSE 'missing' END AS status FROM want LEFT JOIN f USING (company_id, metric) GROUP BY company_id, metric, operation""")
def g19(spark, sf):
    want = table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.lit("revenue").alias("metric"), F.when(F.col("c_custkey") % 2 == 0, "growth").otherwise("value").alias("operation"))
    return X.readiness(facts(spark, sf), want)


@query("s18_insert_if_absent", """WITH b AS (SELECT sha256(o_custkey || '|' || CAST(o_orderdate AS DATE)) AS h, o_orderkey % 2 = 0 AS stored FROM orders), fresh AS (SELECT DISTINCT h FROM b WHERE h NOT IN (SELECT h FROM b WHERE stored))
SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM b) - (SELECT count(*) FROM fresh) AS duplicates""")
def s18(spark, sf):
    rows = table(spark, sf, "orders").select(F.sha2(F.concat_ws("|", "o_custkey", F.col("o_orderdate").cast("date")).cast("binary"), 256).alias("source_hash"), (F.col("o_orderkey") % 2 == 0).alias("stored"))
    return X.insert_new(rows.filter("stored").select("source_hash"), rows.select("source_hash"))[1]


OBS = """o AS (SELECT upper(event_type) AS series_id, CAST(ts AS DATE) AS observed_at, CAST(ts AS DATE) + CAST(event_id % 2 AS INTEGER) AS realtime_start, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE round(avg(value), 6) END AS value FROM events GROUP BY ALL)"""


def observations(spark, sf):
    day = F.col("ts").cast("date")
    return table(spark, sf, "events").groupBy(F.upper("event_type").alias("series_id"), day.alias("observed_at"), F.date_add(day, (F.col("event_id") % 2).cast("int")).alias("realtime_start")).agg(F.when(F.count(F.lit(1)) % 3 == 0, None).otherwise(F.round(F.avg("value"), 6)).alias("value"))


@query("p3_t2_macro_query", f"WITH {OBS} SELECT series_id, observed_at, realtime_start, value FROM o WHERE series_id IN ('CLICK', 'VIEW') AND observed_at BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND value IS NOT NULL")
def p3(spark, sf):
    from datetime import date

    return M.query_macro(observations(spark, sf), MacroRequest((" click", "View"), date(2024, 1, 3), date(2024, 1, 20)))


@query("t2_latest_vintage", f"WITH {OBS}, l AS (SELECT * FROM o WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, observed_at ORDER BY realtime_start DESC) = 1) SELECT series_id, observed_at, realtime_start, value FROM l WHERE series_id IN ('ERROR', 'VIEW') ORDER BY series_id, observed_at DESC LIMIT 40")
def t2(spark, sf):
    return M.query_macro(observations(spark, sf), MacroRequest(("error", "view"), latest_vintage=True, limit=40))


@query("s19_a9_macro_upsert", f"""WITH {OBS}, s AS (SELECT * FROM o WHERE day(observed_at) <= 20), b AS (SELECT series_id, observed_at, realtime_start, CASE WHEN day(observed_at) % 5 = 0 THEN coalesce(value, 0) + 1 ELSE value END AS value FROM o WHERE day(observed_at) > 10),
j AS (SELECT coalesce(s.series_id, b.series_id) AS series_id, CASE WHEN b.series_id IS NULL THEN 'kept' WHEN s.series_id IS NULL THEN 'inserted' WHEN s.value IS NOT DISTINCT FROM b.value THEN 'noop' ELSE 'updated' END AS action, CASE WHEN b.series_id IS NULL THEN s.value ELSE b.value END AS value
FROM s FULL JOIN b ON s.series_id = b.series_id AND s.observed_at = b.observed_at AND s.realtime_start = b.realtime_start)
SELECT series_id, count(*) AS seen, count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE value IS NULL) AS missing FROM j GROUP BY ALL""")
def s19(spark, sf):
    rows = observations(spark, sf)
    hashed = lambda df: df.withColumn("source_hash", F.sha2(F.concat_ws("|", "series_id", F.coalesce(F.col("value").cast("string"), F.lit("-"))).cast("binary"), 256))
    day = F.dayofmonth("observed_at")
    batch = rows.filter(day > 10).withColumn("value", F.when(day % 5 == 0, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")))
    return M.run_counters(M.upsert(hashed(rows.filter(day <= 20)), hashed(batch), ("series_id", "observed_at", "realtime_start")))


@query("a17_stale_series", f"WITH {OBS}, s AS (SELECT series_id, max(observed_at) AS observation_end FROM o GROUP BY ALL), c AS (SELECT series_id, max(observed_at) AS newest FROM o WHERE day(observed_at) <= CASE WHEN series_id < 'P' THEN 10 ELSE 40 END GROUP BY ALL) SELECT series_id, newest, observation_end FROM s JOIN c USING (series_id) WHERE newest < observation_end")
def a17(spark, sf):
    rows = observations(spark, sf)
    cached = rows.filter(F.dayofmonth("observed_at") <= F.when(F.col("series_id") < "P", 10).otherwise(40))
    return M.stale_series(cached, rows.groupBy("series_id").agg(F.max("observed_at").alias("observation_end")))


@query("u3_missing_series", "SELECT * FROM (VALUES ('GDP'), ('RATE')) t(series_id)")
def u3(spark, sf):
    want = spark.createDataFrame([("GDP",), ("CLICK",), ("RATE",), ("VIEW",)], "series_id string")
    return M.missing_series(observations(spark, sf), want)


@query("s20_latest_rows", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def s20(spark, sf):
    return M.latest_rows(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("p2_retrieval_filters", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND n_chars BETWEEN 100 AND 5000")
def p2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("fiscal_period"), F.col("source").alias("source_system"), F.col("n_chars").alias("period_end"))
    return retrieval_filters(docs, RetrievalFilters(fiscal_periods=("en", "fr"), source_systems=("src1", "src2", "src3"), period_end_from=100, period_end_to=5000)).select("doc_id")


@query("j6_catalogue", "SELECT c_custkey AS company_id, n_name, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 THEN 'A' || c_custkey END AS ticker FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j6(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(X.primary_tickers(tickers(spark, sf)), F.col("c_custkey") == F.col("company_id"), "left").select(F.col("c_custkey").alias("company_id"), "n_name", "ticker")

"""Queries over payload parsers: the driver's tables written as JSON payloads, parsed back, against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.functions.udfs import decode_document
from ledgerlake.sources import payloads as P
from ledgerlake.session import table

MAPPING = {"metrics": {"revenue": {"us-gaap": ["C1"]}, "assets": {"us-gaap": ["C2"]}}, "company_overrides": {"0000000007": {"sales": {"us-gaap": ["C1"]}}}}


@query("s1_ticker_map", "SELECT 'T' || c_custkey % 100 AS ticker, lpad(CAST(max(c_custkey) AS VARCHAR), 10, '0') AS cik, arg_max(c_name, c_custkey) AS title FROM customer GROUP BY c_nationkey, c_custkey % 100")
def s1(spark, sf):
    k = F.col("c_custkey")
    row = F.struct(k.cast("string").alias("cik_str"), F.concat(F.lit("t"), k % 100).alias("ticker"), F.col("c_name").alias("title"))
    nations = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k.cast("string"), row)))).alias("payload"))
    return P.ticker_map(nations, ["c_nationkey"]).drop("c_nationkey")


@query("s2_s3_recent_filings", """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderstatus AS form, 'a' || o_orderkey AS accession_number, CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 4 > 0
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) <= 2""")
def s2(spark, sf):
    k = F.col("o_orderkey")
    each = F.array_sort(F.collect_list(F.struct(k.alias("k"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderstatus").alias("form"))))
    column = lambda make: F.transform("rows", make)
    recent = F.struct(
        column(lambda r: F.concat(F.lit("a"), r["k"])).alias("accessionNumber"), column(lambda r: r["day"]).alias("filingDate"), F.array().cast("array<string>").alias("reportDate"),
        column(lambda r: r["form"]).alias("form"), column(lambda r: F.when(r["k"] % 4 == 0, "").otherwise("d.htm")).alias("primaryDocument"),
    )
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(each.alias("rows"))
    sent = held.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    return P.recent_filings(sent, ("F", "O"), 2).select("cik", "form", "accession_number", "filing_date")


def facts_payloads(spark, sf):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    one = F.struct(
        F.when(k % 2 == 0, F.date_sub(day, 89).cast("string")).alias("start"), F.when(k % 9 > 0, day.cast("string")).alias("end"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("val"),
        F.concat(F.lit("a"), k).alias("accn"), F.year(day).alias("fy"), F.lit("Q1").alias("fp"), F.when(k % 5 == 0, "10-Q/A").otherwise("10-Q").alias("form"), day.cast("string").alias("filed"),
    )
    concept = F.concat(F.lit("C"), k % 3)
    # dealt by company once, for both groupings
    units = table(spark, sf, "orders").repartition("o_custkey").groupBy("o_custkey", concept.alias("concept")).agg(F.collect_list(one).alias("o"))
    body = F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.lit("L").alias("label"), F.create_map(F.lit("USD"), F.col("o")).alias("units")))))
    return units.groupBy("o_custkey").agg(body.alias("c")).select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.lit("E").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("c")).alias("facts"))).alias("payload"))


@query("s4_s5_company_facts", """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'C' || o_orderkey % 3 AS concept, CASE o_orderkey % 3 WHEN 1 THEN CASE WHEN o_custkey = 7 THEN 'sales' ELSE 'revenue' END WHEN 2 THEN 'assets' END AS metric, CAST(o_orderdate AS DATE) AS period_end,
round(o_totalprice, 2) AS value, 'a' || o_orderkey AS accession_number, CASE WHEN o_orderkey % 2 = 0 THEN 'quarter' ELSE 'instant' END AS period_type, o_orderkey % 5 = 0 AS is_amendment FROM orders WHERE o_orderkey % 9 > 0""")
def s4(spark, sf):
    return P.company_facts(facts_payloads(spark, sf), MAPPING).select("cik", "concept", "metric", "period_end", F.col("value").cast("double").alias("value"), "accession_number", "period_type", "is_amendment")


@query("s8_unmapped_concepts", "SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'us-gaap' AS taxonomy, 'C0' AS concept FROM orders WHERE o_orderkey % 3 = 0")
def s8(spark, sf):
    return P.unmapped_concepts(facts_payloads(spark, sf), MAPPING)


@query("s7_macro_observations", "SELECT upper(event_type) AS series_id, CAST(ts AS DATE) AS observed_at, CASE WHEN event_id % 4 > 0 THEN round(value, 2) END AS value FROM events")
def s7(spark, sf):
    day = F.col("ts").cast("date").cast("string")
    shown = F.when(F.col("event_id") % 8 == 0, ".").when(F.col("event_id") % 8 == 4, "").otherwise(F.round("value", 2).cast("decimal(18,2)").cast("string"))
    one = F.struct(day.alias("realtime_start"), day.alias("realtime_end"), day.alias("date"), shown.alias("value"))
    sent = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.to_json(F.struct(F.collect_list(one).alias("observations"))).alias("payload"))
    return P.observations_of(sent, F.upper("event_type"), "payload").select("series_id", "observed_at", F.col("value").cast("double").alias("value"))


@query("s27_archive_exhibits", "SELECT 'f' || o_orderkey AS name FROM orders WHERE o_orderkey % 3 = 1 OR o_orderkey % 3 = 2 AND o_orderkey % 2 = 0")
def s27(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 1, "ex-99").when((k % 3 == 2) & (k % 2 == 0), "EX_10").otherwise("10-K")
    item = F.struct(F.concat(F.lit("f"), k).alias("name"), kind.alias("type"))
    sent = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("item")).alias("directory"))).alias("payload"))
    return P.archive_exhibits(sent, "main.htm").select("name")


@query("s9_pdf_manifest", "SELECT 'd' || i AS id, '00000000' || lpad(CAST(i AS VARCHAR), 2, '0') AS cik, 2000 + i AS fiscal_year FROM range(1, 6) t(i)")
def s9(spark, sf):
    text = "documents:\n" + "".join(f"- {{id: d{k}, company_name: C{k}, cik: {k}, title: T, document_type: annual, fiscal_year: {2000 + k}, period_end: 2024-12-31, url: 'https://example.org/{k}.pdf'}}\n" for k in range(1, 6))
    return P.pdf_manifest(spark, P.load_yaml(text)).select("id", "cik", F.col("fiscal_year").cast("long").alias("fiscal_year"))


@query("s12_decoded", r"SELECT item_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10))) AS hash FROM benchmark")
def s12(spark, sf):
    rows = table(spark, sf, "benchmark")
    return rows.select("item_id", F.sha2(decode_document(F.col("text").cast("binary"), F.lit("text/plain")).cast("binary"), 256).alias("hash"))

"""Ingestion runs in a store: each source is loaded in part, then whole with some changes, then once more as it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.operators import runs as R
from ledgerlake.queries.payloads import MAPPING, facts_payloads
from ledgerlake.session import stored, table
from ledgerlake.sources.store import Store

COUNTERS = ("run", "source", "status", "items_seen", "rows_seen", "inserted", "updated", "duplicates", "missing", "failures")


def macro_items(spark, sf, changed: bool):
    """A series for each type and fortieth of the users; one lacks its metadata, one its observations."""
    k, day = F.col("event_id"), F.col("ts").cast("date").cast("string")
    value = F.round("value", 2) + F.when((k % 10 == 0) & F.lit(changed), 1).otherwise(0)
    shown = F.when(k % 8 == 0, ".").otherwise(value.cast("decimal(18,2)").cast("string"))
    one = F.struct(F.date_add(F.lit("1970-01-01").cast("date"), k.cast("int")).cast("string").alias("date"), day.alias("realtime_start"), day.alias("realtime_end"), shown.alias("value"))
    rows = table(spark, sf, "events").filter(F.lit(changed) | (k % 10 < 7)).withColumn("n", F.col("user_id") % 40)
    each = rows.groupBy("event_type", "n").agg(F.collect_list(one).alias("observations")).withColumn("id", F.concat(F.upper("event_type"), "n"))
    told = F.struct(F.array(F.struct("id", F.lit("a series").alias("title"), F.lit("1970-01-01").alias("observation_start"), F.lit("2030-01-01").alias("observation_end"), F.lit("$").alias("units_short"))).alias("seriess"))
    metadata = F.when((F.col("event_type") == "click") & (F.col("n") == 3), "{}").otherwise(F.to_json(told))
    observations = F.when((F.col("event_type") == "view") & (F.col("n") == 4), "[").otherwise(F.to_json(F.struct("observations")))
    return each.select(F.col("id").alias("series_id"), metadata.alias("metadata"), observations.alias("observations"))


def macro_store(spark, sf):
    store = Store(spark, R.TABLES)
    for run, changed in (("a", False), ("b", True), ("c", True), ("a", True)):  # the last is published already
        R.macro_run(store, run, macro_items(spark, sf, changed))
    return store


_MACRO = """WITH e AS (SELECT *, upper(event_type) || user_id % 40 AS s, event_type = 'click' AND user_id % 40 = 3 OR event_type = 'view' AND user_id % 40 = 4 AS bad, event_id % 8 = 0 AS gap FROM events),
r AS (SELECT 'a' AS run, * FROM e WHERE event_id % 10 < 7 UNION ALL SELECT 'b', * FROM e UNION ALL SELECT 'c', * FROM e)"""


@query("s32_macro_runs", f"""{_MACRO}, n AS (SELECT run, count(DISTINCT s) FILTER (NOT bad) AS items_seen, count(*) FILTER (NOT bad) AS rows_seen, count(*) FILTER (NOT bad AND (run = 'a' OR run = 'b' AND event_id % 10 >= 7)) AS inserted,
count(*) FILTER (NOT bad AND run = 'b' AND event_id % 10 = 0 AND NOT gap) AS updated, count(*) FILTER (NOT bad AND gap) AS missing, count(DISTINCT s) FILTER (bad) AS failures FROM r GROUP BY run)
SELECT run, 'macro' AS source, CASE WHEN failures = 0 THEN 'success' ELSE 'partial_failed' END AS status, items_seen, rows_seen, inserted, updated, rows_seen - inserted - updated AS duplicates, missing, failures FROM n""")
def s32_macro(spark, sf):
    return macro_store(spark, sf).table("runs").select(*COUNTERS)


@query("s32_macro_observations", f"""{_MACRO} SELECT s AS series_id, DATE '1970-01-01' + CAST(event_id AS INTEGER) AS observed_at, CAST(ts AS DATE) AS realtime_start, CASE WHEN NOT gap THEN round(round(value, 2) + CAST(event_id % 10 = 0 AS INTEGER), 2) END AS value, '$' AS unit,
CASE WHEN event_id % 10 = 0 AND NOT gap THEN 2 WHEN event_id % 10 < 7 THEN 1 ELSE 2 END AS last_run, CASE WHEN event_id % 10 = 0 AND NOT gap THEN 2 ELSE 1 END AS n_written FROM e WHERE NOT bad""")
def s32_macro_rows(spark, sf):
    """Every observation as it stands, with the run that wrote it and how many rows it took: a rerun writes none."""
    rows = macro_store(spark, sf).table("observations")
    keys = ["series_id", "observed_at", "realtime_start"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("value", "unit"), "_run").alias("r"), F.max("_run").alias("last_run"), F.count(F.lit(1)).alias("n_written"))
    return last.select(*keys, F.col("r.value").cast("double").alias("value"), "r.unit", "last_run", "n_written")


@query("s32_macro_failures", f"{_MACRO} SELECT DISTINCT run, s AS item, 'series' AS stage, CASE WHEN event_type = 'click' THEN 'no metadata' ELSE 'no observations' END AS message FROM r WHERE bad")
def s32_macro_failed(spark, sf):
    return macro_store(spark, sf).table("failures").drop("_run")


def filings_store(spark, sf):
    """A company for each customer; every eleventh sends no submissions, and every thirteenth order has no document."""
    k = F.col("o_orderkey")
    each = F.array_sort(F.collect_list(F.struct(k.alias("k"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderstatus").alias("form"))))
    column = lambda make: F.transform("rows", make)
    recent = F.struct(
        column(lambda r: F.concat(F.lit("a"), r["k"])).alias("accessionNumber"), column(lambda r: r["day"]).alias("filingDate"), F.array().cast("array<string>").alias("reportDate"),
        column(lambda r: r["form"]).alias("form"), column(lambda r: F.when(r["k"] % 4 == 0, "").otherwise("d.htm")).alias("primaryDocument"),
    )
    sent = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings")))
    orders = table(spark, sf, "orders")
    items = stored(orders.groupBy("o_custkey").agg(each.alias("rows")).select(F.concat(F.lit("T"), "o_custkey").alias("ticker"), F.when(F.col("o_custkey") % 11 == 0, "{").otherwise(sent).alias("submissions")))
    documents = lambda n: orders.select(F.concat(F.lit("a"), k).alias("accession_number"), F.when(k % 13 > 0, F.concat(F.lit("document "), k, F.when((k % 5 == 0) & F.lit(n > 1), " again").otherwise(""))).cast("binary").alias("content"))
    store = Store(spark, R.TABLES)
    for run, n in (("a", 1), ("b", 2), ("c", 2)):
        R.filings_run(store, run, items, documents(n), ("F", "O"), 2)
    return store


_FILINGS = """WITH f AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 4 > 0 AND o_custkey % 11 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) <= 2), r AS (SELECT unnest(['a', 'b', 'c']) AS run)"""


@query("s32_filing_runs", f"""{_FILINGS}, c AS (SELECT count(DISTINCT o_custkey) FILTER (o_custkey % 11 > 0) AS good, count(DISTINCT o_custkey) FILTER (o_custkey % 11 = 0) AS bad FROM orders), n AS (SELECT count(*) FILTER (o_orderkey % 13 > 0) AS seen, count(*) FILTER (o_orderkey % 13 > 0 AND o_orderkey % 5 = 0) AS new, count(*) FILTER (o_orderkey % 13 = 0) AS lost FROM f)
SELECT run, 'filings' AS source, 'partial_failed' AS status, good AS items_seen, seen AS rows_seen, CASE WHEN run = 'a' THEN seen ELSE 0 END AS inserted, CASE WHEN run = 'b' THEN new ELSE 0 END AS updated, CASE run WHEN 'a' THEN 0 WHEN 'b' THEN seen - new ELSE seen END AS duplicates, 0 AS missing, bad + lost AS failures FROM r, c, n""")
def s32_filings(spark, sf):
    return filings_store(spark, sf).table("runs").select(*COUNTERS)


@query("s32_filing_versions", f"""{_FILINGS} SELECT 'a' || o_orderkey AS accession_number, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filing_date, n AS _run, sha256('document ' || o_orderkey || CASE WHEN n = 2 THEN ' again' ELSE '' END) AS content_hash FROM f, (SELECT unnest([1, 2]) AS n) WHERE o_orderkey % 13 > 0 AND (n = 1 OR o_orderkey % 5 = 0)""")
def s32_versions(spark, sf):
    """Every version with its filing, which is stored once."""
    store = filings_store(spark, sf)
    return store.table("versions").join(store.table("filings").drop("_run"), "accession_number").select("accession_number", "form", "filing_date", "_run", "content_hash")


@query("s32_filing_failures", f"{_FILINGS} SELECT run, 'T' || o_custkey AS item, 'company' AS stage, 'no submissions' AS message FROM r, (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 11 = 0) UNION ALL SELECT run, 'a' || o_orderkey, 'filing', 'no document' FROM r, f WHERE o_orderkey % 13 = 0")
def s32_filings_failed(spark, sf):
    return filings_store(spark, sf).table("failures").drop("_run")


def facts_store(spark, sf):
    """Half of the companies first, beside three broken payloads: none, no JSON, and JSON without facts."""
    good = stored(facts_payloads(spark, sf).select(F.get_json_object("payload", "$.cik").alias("ticker"), "payload"))
    bad = spark.createDataFrame([("x", None), ("y", "{"), ("z", "{}")], "ticker string, payload string")
    store = Store(spark, R.TABLES)
    for run, items in (("a", good.filter("cast(ticker as long) % 2 = 0").unionByName(bad)), ("b", good), ("c", good)):
        R.facts_run(store, run, items, MAPPING)
    return store


_FACTS = "WITH f AS (SELECT *, o_custkey % 2 = 0 AS early FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 3 > 0)"


@query("s32_facts_runs", f"""{_FACTS}, n AS (SELECT count(*) AS seen, count(*) FILTER (early) AS half FROM f), c AS (SELECT count(DISTINCT o_custkey) AS all_of, count(DISTINCT o_custkey) FILTER (o_custkey % 2 = 0) AS half_of FROM orders)
SELECT run, 'facts' AS source, CASE WHEN run = 'a' THEN 'partial_failed' ELSE 'success' END AS status, CASE WHEN run = 'a' THEN half_of ELSE all_of END AS items_seen, CASE WHEN run = 'a' THEN half ELSE seen END AS rows_seen, CASE run WHEN 'a' THEN half WHEN 'b' THEN seen - half ELSE 0 END AS inserted, 0 AS updated,
CASE run WHEN 'a' THEN 0 WHEN 'b' THEN half ELSE seen END AS duplicates, 0 AS missing, CASE WHEN run = 'a' THEN 3 ELSE 0 END AS failures FROM n, c, (SELECT unnest(['a', 'b', 'c']) AS run)""")
def s32_facts(spark, sf):
    return facts_store(spark, sf).table("runs").select(*COUNTERS)


@query("s32_facts_loaded", f"{_FACTS} SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'C' || o_orderkey % 3 AS concept, CASE WHEN o_orderkey % 3 = 2 THEN 'assets' WHEN o_custkey = 7 THEN 'sales' ELSE 'revenue' END AS metric, CAST(o_orderdate AS DATE) AS period_end, round(o_totalprice, 2) AS value, 'a' || o_orderkey AS accession_number, CASE WHEN early THEN 1 ELSE 2 END AS _run FROM f")
def s32_facts_rows(spark, sf):
    return facts_store(spark, sf).table("facts").select("cik", "concept", "metric", "period_end", F.col("value").cast("double").alias("value"), "accession_number", "_run")


@query("s32_facts_failures", "SELECT 'a' AS run, item, 'company_facts' AS stage, message FROM (VALUES ('x', 'no payload'), ('y', 'payload has no facts'), ('z', 'payload has no facts')) t(item, message), (SELECT count(*) AS n FROM orders) WHERE n > 0")
def s32_facts_failed(spark, sf):
    return facts_store(spark, sf).table("failures").drop("_run")

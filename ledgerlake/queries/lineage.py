"""Queries over chunks and their parents: line items are chunks, orders sections, customers versions, nations documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.operators import lineage as L
from ledgerlake.queries.facts import ROWS, companies, facts, tickers
from ledgerlake.session import table
from ledgerlake.streaming.events import claimable, expired_sessions


@query("j1_chunk_lineage", """SELECT l_orderkey AS section_id, l_linenumber, o_custkey AS version_id, c_nationkey AS document_id, r_name AS company_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def j1(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("section_id"), "l_linenumber")
    sections = table(spark, sf, "orders").select(F.col("o_orderkey").alias("section_id"), F.col("o_custkey").alias("version_id"))
    versions = table(spark, sf, "customer").select(F.col("c_custkey").alias("version_id"), F.col("c_nationkey").alias("document_id"))
    documents = table(spark, sf, "nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_regionkey").alias("company_id"))
    named = table(spark, sf, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("company_id"), F.col("r_name").alias("company_name"))
    return L.chunk_lineage(chunks, sections, versions, documents, named).select("section_id", "l_linenumber", "version_id", "document_id", "company_name")


def hashed_chunks(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    now = F.sha2(F.col("text").cast("binary"), 256)
    then = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256)
    return d.select(F.col("doc_id").alias("chunk_id"), now.alias("content_hash")), d.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("chunk_id"), then.alias("content_hash"))


@query("j2_p4_fresh_embeddings", "SELECT doc_id AS chunk_id FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 0 AND doc_id % 3 <> 0")
def j2(spark, sf):
    return L.fresh_embeddings(*hashed_chunks(spark, sf)).select("chunk_id")


@query("j17_stale_embeddings", "SELECT doc_id AS chunk_id FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 0 AND doc_id % 3 = 0")
def j17(spark, sf):
    return L.stale_embeddings(*hashed_chunks(spark, sf))


@query("j3_r22_fact_evidence", f"""WITH {ROWS}, t AS (SELECT fact_id, c_name || ' revenue: ' || regexp_replace(CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '') || ' USD (' || period_type || ' ending ' || period_end || ')' AS content, fiscal_year || ':' || fiscal_period AS period FROM f JOIN customer ON company_id = c_custkey)
SELECT 'fact:' || fact_id AS label, period, content, greatest(1, CAST(ceil(length(content) / 4.0) AS BIGINT)) AS tokens FROM t""")
def j3(spark, sf):
    rows = facts(spark, sf).withColumn("value", F.col("value").cast("decimal(18,2)")).join(companies(spark, sf), "company_id")
    return L.fact_evidence(rows).select("label", "period", "content", "tokens")


@query("j7_r24_summaries", "SELECT c_custkey AS version_id, c_name AS summary FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('P')) AND c_custkey % 2 = 0")
def j7(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("version_id"), F.col("c_name").alias("summary"))
    sections = table(spark, sf, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderstatus").alias("section_code"))
    return L.summaries_of(c, c.select("version_id").filter("version_id % 2 = 0"), sections, ("P",)).select("version_id", "summary")


@query("r14_first_summary", "SELECT o_custkey AS parent, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS summary FROM orders GROUP BY ALL")
def r14(spark, sf):
    return L.first_summary(table(spark, sf, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("summary"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("summary_id")), "parent")


VERSIONS = "v AS (SELECT o_orderkey AS version_id, o_custkey AS company_id, o_orderstatus AS kind, o_orderkey % 2 = 0 AS is_current, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS filing_date FROM orders)"


def versions(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("version_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderstatus").alias("kind"), (k % 2 == 0).alias("is_current"), F.when(k % 5 > 0, F.col("o_orderdate").cast("date")).alias("filing_date"))


@query("j16_ticker_versions", f"WITH {VERSIONS} SELECT version_id, filing_date FROM v WHERE is_current AND kind IN ('F', 'P') AND company_id IN (7, 10, 13)")
def j16(spark, sf):
    return L.current_versions(versions(spark, sf), tickers(spark, sf), ("t7", "A10 ", "T13"), ("F", "P")).select("version_id", "filing_date")


@query("t9_d1_document_selection", f"WITH {VERSIONS} SELECT version_id, filing_date FROM v WHERE is_current AND kind = 'O' ORDER BY filing_date DESC NULLS LAST, version_id LIMIT 100")
def t9(spark, sf):
    return L.selected_documents(versions(spark, sf), ("O",), 100).select("version_id", "filing_date")


@query("r27_chunks_to_index", "SELECT event_id AS chunk_id FROM events WHERE user_id % 3 = 0 AND user_id < 10 ORDER BY ts, event_id LIMIT 200")
def r27(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), F.col("user_id").alias("version_id"), F.col("ts").alias("created_at"))
    return L.chunks_to_index(rows, 200, (0, 3, 6, 9)).select("chunk_id")


@query("j15_looked_up", "SELECT vec_id AS chunk_id, vec_id % 101 AS rank, 'k' || vec_id AS key FROM embeddings WHERE vec_id % 2 = 0")
def j15(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return L.looked_up(v.withColumn("rank", F.col("chunk_id") % 101), v.filter("chunk_id % 2 = 0").withColumn("key", F.concat(F.lit("k"), F.col("chunk_id"))))


@query("w11_chunk_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS chunk_index FROM lineitem WHERE l_returnflag <> 'R'")
def w11(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("kept"))
    return L.indexed_chunks(rows, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("chunk_index").cast("long").alias("chunk_index"))


@query("w13_section_ends", "SELECT l_orderkey, l_linenumber, CAST(coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 100) AS BIGINT) AS stop FROM lineitem")
def w13(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(100).alias("n"))
    return L.section_ends(rows, "l_orderkey", "l_linenumber", "n").select("l_orderkey", "l_linenumber", F.col("stop").cast("long").alias("stop"))


@query("u1_last_by_id", "WITH u AS (SELECT event_id % 300 AS evidence_id, event_id AS position, event_type AS body, event_id % 2 AS part FROM events) SELECT evidence_id, arg_max(body, part * 1000000000 + position) AS body FROM u GROUP BY ALL")
def u1(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_id") % 300).alias("evidence_id"), F.col("event_id").alias("position"), F.col("event_type").alias("body"))
    return L.last_by_id([rows.filter("position % 2 = 0"), rows.filter("position % 2 = 1")]).select("evidence_id", "body")


@query("u4_r23_sufficient", "SELECT user_id, list_contains(list(event_type), 'purchase') AND list_contains(list(event_type), 'signup') AS enough FROM events GROUP BY ALL")
def u4(spark, sf):
    have = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return have.select("user_id", L.sufficient(F.col("have"), F.array(F.lit("purchase"), F.lit("signup"))).alias("enough"))


@query("u5_ordered_distinct", "SELECT event_type, min(event_id) AS first_place FROM events GROUP BY ALL")
def u5(spark, sf):
    return L.ordered_distinct(table(spark, sf, "events"), "event_type", "event_id")


@query("u7_w10_deferred_last", "WITH r AS (SELECT user_id AS lane, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 2 AS deferred FROM events) SELECT lane, event_id, deferred, row_number() OVER (PARTITION BY lane ORDER BY deferred, event_id) AS place FROM r")
def u7(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("lane"), "event_id", "event_type")
    return L.deferred_last(rows, "event_type", "event_id", 2).select("lane", "event_id", "deferred", F.col("place").cast("long").alias("place"))


@query("t6_newest_facts", "WITH o AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS fact_id, arg_min(CAST(o_orderdate AS DATE), o_orderkey) AS period_end FROM orders GROUP BY ALL) SELECT o_custkey, o_orderstatus, fact_id, period_end FROM o ORDER BY period_end DESC, fact_id LIMIT 12")
def t6(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").cast("date").alias("period_end"))
    return L.newest_facts(rows, ["o_custkey", "o_orderstatus"])


@query("t7_expired_sessions", "SELECT event_id AS session_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND (event_id % 3 = 0 OR ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-20 00:00:00') ORDER BY ts, event_id LIMIT 100")
def t7(spark, sf):
    ts = F.col("ts")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("session_id"), ts.alias("expires_at"), F.when(F.col("event_id") % 3 != 0, ts + F.expr("interval 1 day")).alias("lease_until"))
    return expired_sessions(rows, datetime(2024, 1, 20), 100).select("session_id")


@query("t8_claimable_run", "SELECT event_id AS run_id FROM events WHERE event_id % 11 = 3 OR (event_id % 11 = 4 AND ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-10 00:00:00') ORDER BY ts, event_id LIMIT 1")
def t8(spark, sf):
    k = F.col("event_id") % 11
    rows = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.when(k == 3, "queued").when(k == 4, "running").otherwise("done").alias("status"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("lease_until"))
    return claimable(rows, datetime(2024, 1, 10)).select("run_id").limit(1)


@query("j13_macro_used", """WITH m AS (SELECT DISTINCT event_type AS series_id, CAST(ts AS DATE) AS observed_at FROM events WHERE day(ts) % 3 = 0), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE day(ts) IN (2, 4, 5, 17, 25))
SELECT DISTINCT m.series_id, m.observed_at FROM m JOIN d ON d.day >= m.observed_at WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.series_id = m.series_id AND n.observed_at > m.observed_at AND n.observed_at <= d.day)""")
def j13(spark, sf):
    days = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("observed_at")).distinct()
    return L.macro_used(days.filter(F.dayofmonth("observed_at") % 3 == 0), days.filter(F.dayofmonth("observed_at").isin(2, 4, 5, 17, 25)))

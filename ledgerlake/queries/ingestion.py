"""Queries over ingestion runs, artifacts, sections, pacing, run events and what only callers used before."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.functions import embed as E
from ledgerlake.operators import documents as D, entities, facts as X, ingestion as I, stores as S
from ledgerlake.queries.facts import facts
from ledgerlake.queries.payloads import MAPPING, facts_payloads
from ledgerlake.session import shared_folder, stored, table
from ledgerlake.sources import artifact_store as A


@query("s17_artifacts", "SELECT 'p' || item_id AS path, sha256(text) AS content_hash, strlen(text) AS size_bytes FROM benchmark WHERE item_id % 3 > 0 AND text IS NOT NULL")
def s17(spark, sf):
    """A third of the paths hold the same bytes already, another third other bytes."""
    rows = table(spark, sf, "benchmark").filter("text is not null").select(F.concat(F.lit("p"), "item_id").alias("path"), F.col("text").alias("content"), "item_id")
    held = rows.filter("item_id % 3 < 2").select("path", F.sha2(F.when(F.col("item_id") % 3 == 0, F.col("content")).otherwise("other").cast("binary"), 256).alias("content_hash"))
    return I.artifacts(rows, held).drop("content")


@query("s17_artifact_store", """WITH a AS (SELECT 'p' || doc_id % 300 AS path, text FROM documents WHERE text IS NOT NULL), b AS (SELECT path, max(sha256(text)) AS content_hash FROM a GROUP BY path), c AS (SELECT DISTINCT b.path, content_hash, text FROM b JOIN a ON a.path = b.path AND sha256(a.text) = content_hash)
SELECT path, CASE WHEN substr(path, -1) = '7' THEN sha256(text || '!') ELSE content_hash END AS content_hash, strlen(text) + CAST(substr(path, -1) = '7' AS INTEGER) AS size_bytes, 1 + CAST(substr(path, -1) = '7' AS BIGINT) AS n_loads, CASE WHEN substr(path, -1) = '7' THEN text || '!' ELSE text END AS content FROM c""")
def s17_store(spark, sf):
    """Written, written again, which adds nothing, then a tenth of the paths with other bytes; read back from the store."""
    root = shared_folder(spark)
    rows = table(spark, sf, "documents").filter("text is not null").select(F.concat(F.lit("p"), F.col("doc_id") % 300).alias("path"), F.col("text").alias("content"))
    for _ in range(2):
        A.add(spark, root, rows)
    held = A.contents(spark, root, A.references(spark, root)).filter("path like '%7'")
    A.add(spark, root, stored(held.select("path", F.concat(F.col("content").cast("string"), F.lit("!")).alias("content"))))
    return A.contents(spark, root, A.references(spark, root)).select("path", "content_hash", "size_bytes", "n_loads", F.col("content").cast("string").alias("content"))


@query("s17_pretty_json", "SELECT c_custkey, '{' || chr(10) || '  \"a\": ' || c_custkey || ',' || chr(10) || '  \"b\": [' || chr(10) || '    1' || chr(10) || '  ]' || chr(10) || '}' AS shown FROM customer")
def s17_json(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", I.pretty_json(F.concat(F.lit('{"b": [1], "a": '), "c_custkey", F.lit("}"))).alias("shown"))


@query("s32_facts_run", """WITH o AS (SELECT *, 'C' || o_orderkey % 3 AS c FROM orders), n AS (SELECT count(DISTINCT o_custkey) AS companies FROM orders), u AS (SELECT count(DISTINCT o_custkey) AS u FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT count(*) AS seen FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 3 > 0)
SELECT 'partial_failed' AS status, companies AS companies_seen, seen AS facts_seen, seen AS facts_inserted, CAST(0 AS BIGINT) AS duplicates_skipped, u AS unmapped_concepts, CAST(3 AS BIGINT) AS failures FROM n, u, f""")
def s32(spark, sf):
    """Three payloads are broken: none, no JSON, and JSON without facts."""
    good = facts_payloads(spark, sf).select(F.get_json_object("payload", "$.cik").alias("ticker"), "payload")
    bad = spark.createDataFrame([("x", None), ("y", "{"), ("z", "{}")], "ticker string, payload string")
    held = spark.createDataFrame([], "source_hash string")
    return I.facts_run(good.unionByName(bad), MAPPING, held)[2]


@query("s33_sections", """WITH h AS (SELECT l_orderkey AS version_id, l_linenumber AS section_key, max(l_quantity) AS start FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL), n AS (SELECT l_orderkey AS version_id, l_linenumber AS section_key, max(l_quantity) + 1 AS start FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL)
SELECT coalesce(n.version_id, h.version_id) AS version_id, coalesce(n.section_key, h.section_key) AS section_key, coalesce(n.start, h.start) AS start FROM h FULL JOIN n ON h.version_id = n.version_id AND h.section_key = n.section_key""")
def s33(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("section_key"), F.col("l_quantity").alias("start"))
    return I.upsert_sections(rows.filter("section_key < 5"), rows.filter("section_key > 2").withColumn("start", F.col("start") + 1))


@query("d3_pdf_sections", "SELECT l_orderkey AS version_id, string_agg('t' || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber) AS section_text, min(l_linenumber) AS page_start, max(l_linenumber) AS page_end FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY ALL")
def d3(spark, sf):
    n = F.col("l_linenumber")
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id"), n.alias("page"), F.when(n % 3 == 0, " \n ").otherwise(F.concat(F.lit(" t"), n, F.lit("\n"))).alias("text"))
    return I.pdf_sections(pages)


@query("d9_candidate_counts", "SELECT doc_id AS version, CAST(count(*) AS VARCHAR) AS candidates FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id")
def d9_counts(spark, sf):
    """Diagnostics of the greedy decisions on every document's lines: all candidates are told, and each has one decision."""
    from ledgerlake.queries.texts import versions

    told = I.candidate_diagnostics(D.drop_near_copies(versions(spark, sf), "version", "chunk_index", "text", 0.9).withColumn("decision", F.regexp_replace("decision", "^near.*", "near_copy")))
    n = lambda name: F.get_json_object("diagnostics", f"$.{name}")
    whole = n("kept").cast("int") + n("near_copies").cast("int") + n("boilerplate").cast("int") == n("candidates").cast("int")
    return told.select("version", F.when(whole, n("candidates")).alias("candidates"))


@query("d10_left_rows", "SELECT 'chunks' AS name, l_orderkey AS version_id, l_linenumber AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'summaries', o_orderkey, 0 FROM orders WHERE o_orderstatus <> 'F'")
def d10_rows(spark, sf):
    """The rows that are left once the outputs of finished orders are cleared."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), "o_orderstatus")
    left = I.cleared({"chunks": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("id")), "summaries": orders.withColumn("id", F.lit(0))}, orders.filter("o_orderstatus = 'F'"))
    return left["chunks"].withColumn("name", F.lit("chunks")).unionByName(left["summaries"].select("version_id", "id", F.lit("summaries").alias("name")))


@query("d9_diagnostics", """SELECT l_orderkey AS version, '{"candidates":' || count(*) || ',"kept":' || count(*) FILTER (WHERE l_linenumber % 3 = 0) || ',"near_copies":' || count(*) FILTER (WHERE l_linenumber % 3 = 1) || ',"boilerplate":' || count(*) FILTER (WHERE l_linenumber % 3 = 2) || '}' AS diagnostics FROM lineitem GROUP BY ALL""")
def d9(spark, sf):
    k = F.col("l_linenumber") % 3
    return I.candidate_diagnostics(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version"), F.when(k == 0, "kept").when(k == 1, "near_copy").otherwise("boilerplate").alias("decision")))


@query("d10_cleared", "SELECT 'chunks' AS name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'summaries', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def d10(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), "o_orderstatus")
    left = I.cleared({"chunks": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id")), "summaries": orders}, orders.filter("o_orderstatus = 'F'"))
    return left["chunks"].agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit("chunks")).unionByName(left["summaries"].agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit("summaries")))


@query("t5_demo_chunks", "SELECT l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, l_returnflag, l_linenumber, l_orderkey * 10 + l_linenumber LIMIT 5")
def t5(spark, sf):
    dates = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.lit("t").alias("title"), F.lit("k").alias("kind"), F.col("l_returnflag").alias("ordinal_path"), F.col("l_linenumber").alias("chunk_index"), F.lit(1).alias("tokens"), F.lit("x").alias("text"))
    return I.demo_chunks(lines.join(dates, F.col("l_orderkey") == F.col("o_orderkey"))).select("chunk_id")


@query("st11_paced_requests", """WITH r AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, round(max(t - k * 36000) OVER (PARTITION BY user_id ORDER BY k) + k * 36000, 3) AS starts FROM r""")
def st11(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return I.paced(rows, 1 / 36000, "user_id", "at", "event_id").select("event_id", F.round("starts", 3).alias("starts"))


@query("st14_task_events", """WITH t AS (SELECT event_id, user_id AS run_id, event_id % 4 AS k FROM events)
SELECT run_id, 'node:' || event_id || ':started' AS event_key, 'started' AS status, NULL AS summary FROM t UNION ALL SELECT run_id, 'tool:' || event_id || ':started', 'started', NULL FROM t WHERE k IN (1, 2)
UNION ALL SELECT run_id, 'node:' || event_id || ':finished', CASE WHEN k = 1 THEN 'failed' ELSE 'completed' END, CASE WHEN k = 1 THEN 'Execution step failed.' WHEN k = 2 THEN 'done' ELSE 'Execution step completed.' END FROM t WHERE k > 0""")
def st14(spark, sf):
    k = F.col("event_id") % 4
    tasks = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").cast("string").alias("task_id"), F.lit("execute").alias("node"), F.when(k > 0, F.lit("b")).alias("branch_id"), F.when(k == 3, "chart").otherwise("macro_series").alias("kind"),
        F.lit(1).alias("attempt"), F.when(k > 1, "completed").alias("status"), F.when(k == 2, "done").alias("summary"), F.when(k == 1, "e").alias("error"), F.lit(5).cast("long").alias("duration_ms"),
    )
    return I.task_events(tasks).select("run_id", "event_key", "status", "summary")


@query("st15_feedback", "SELECT o_orderkey AS run_id, o_orderkey % 5 AS rating FROM orders WHERE o_orderstatus <> 'P'")
def st15(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("rating"), F.lit(None).cast("string").alias("comment"), F.lit("a").alias("actor_id"))
    return I.append_feedback(orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("run_id")), rows, datetime(2024, 1, 1)).select("run_id", "rating")


@query("f33_company_labels", "SELECT c_custkey, 'firm ' || c_custkey AS label FROM customer")
def f33(spark, sf):
    name = F.concat(F.lit("Firm "), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, ", Inc. Class A").otherwise(" Company Ltd."))
    return table(spark, sf, "customer").select("c_custkey", I.company_label(name).alias("label"))


@query("s28_ready_companies", "SELECT DISTINCT o_custkey AS company_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def s28(spark, sf):
    chunks = table(spark, sf, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("company_id"))
    return X.ready_companies(chunks, facts(spark, sf))


@query("s30_newest_filings", "SELECT o_custkey AS company_id, CASE WHEN o_orderkey % 4 = 0 THEN '10-K' ELSE '10-Q' END AS form, arg_max('a' || o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'a' || o_orderkey) AS accession_number FROM orders GROUP BY ALL")
def s30_filings(spark, sf):
    """The newest filing of each company and form."""
    form = F.when(F.col("o_orderkey") % 4 == 0, "10-K").otherwise("10-Q")
    filings = table(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), form.alias("form"), F.col("o_orderdate").cast("date").alias("filing_date"), F.concat(F.lit("a"), "o_orderkey").alias("accession_number"))
    return S.source_checks(facts(spark, sf), filings)[1]


@query("s30_check_counts", "WITH c AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY o_custkey) SELECT CASE WHEN day >= DATE '2001-07-01' THEN 'current' WHEN day >= DATE '2000-07-01' THEN 'stale' ELSE 'outdated' END AS status, count(*) AS n FROM c GROUP BY ALL")
def s30_counts(spark, sf):
    """How many companies' newest facts are current, stale or outdated."""
    newest = S.source_checks(facts(spark, sf), facts(spark, sf).select("company_id", F.lit("10-K").alias("form"), F.col("period_end").alias("filing_date"), "accession_number"))[0]
    return S.check_counts(newest, "2001-07-01", "2000-07-01")


@query("s30_source_checks", "SELECT o_custkey AS company_id, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS day, arg_max(o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS fact_id FROM orders GROUP BY ALL")
def s30(spark, sf):
    filings = facts(spark, sf).select("company_id", F.lit("10-K").alias("form"), F.col("period_end").alias("filing_date"), "accession_number")
    return S.source_checks(facts(spark, sf), filings)[0].select("company_id", "day", "fact_id")


@query("f21_vector_text", "SELECT vec_id, true AS same, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL")
def f21(spark, sf):
    rows = table(spark, sf, "embeddings").filter("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    back = rows.withColumn("b", E.parse_vector(E.vector_text(F.col("v"))))
    return back.select("vec_id", (F.col("b") == F.col("v")).alias("same"), F.size("b").cast("long").alias("n"))


@query("e16_refers_back", "SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS back FROM customer")
def e16(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "Compare BOTH companies again").otherwise("bothered")
    return table(spark, sf, "customer").select("c_custkey", entities.refers_back(text, ("both", "these companies"), F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(1)))).alias("back"))


@query("d2_section_inputs", """SELECT o_orderkey AS version_id, 'body' AS section_key, CAST(2 AS BIGINT) AS start, substr(o_orderpriority || 'x', 3, 3) AS section_text FROM orders WHERE o_orderkey % 2 = 0 AND trim(substr(o_orderpriority || 'x', 3, 3)) = substr(o_orderpriority || 'x', 3, 3)
UNION ALL SELECT o_orderkey, 'body', 2, trim(substr(o_orderpriority || 'x', 3, 3)) FROM orders WHERE o_orderkey % 2 = 0 AND trim(substr(o_orderpriority || 'x', 3, 3)) <> substr(o_orderpriority || 'x', 3, 3) UNION ALL SELECT o_orderkey, 'document', 0, o_orderpriority || 'x' FROM orders WHERE o_orderkey % 2 = 1""")
def d2(spark, sf):
    versions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), F.concat("o_orderpriority", F.lit("x")).alias("text"))
    sections = versions.filter("version_id % 2 = 0").select("version_id", F.lit("body").alias("section_key"), F.lit(2).alias("start"), F.lit(5).alias("stop"))
    return D.section_inputs(versions, sections, "version_id", "text")


@query("r13_warnings", "WITH c AS (SELECT lang, doc_id, doc_id % 2 = 0 AND lang <> 'fr' AS indexed, doc_id % 6 = 0 AND lang IN ('en', 'de') AS dense FROM documents) SELECT lang, CASE WHEN count(*) FILTER (indexed) = 0 THEN 'missing_embedding_index' ELSE 'missing_dense_candidates' END AS warning FROM c GROUP BY lang HAVING count(*) FILTER (dense) = 0 OR count(*) FILTER (indexed) = 0")
def r13(spark, sf):
    """By language: French has no vectors, and only English and German any dense candidates."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    index = chunks.filter("chunk_id % 2 = 0 and lang <> 'fr'")
    return I.retrieval_warnings(chunks, index.withColumn("dense_rank", F.when((F.col("chunk_id") % 6 == 0) & F.col("lang").isin("en", "de"), 1)), index, by=["lang"])


@query("r28_chunk_evidence", "SELECT 'chunk:' || doc_id AS label, lang AS content, '2024:Q' || doc_id % 4 AS period FROM documents WHERE doc_id % 2 = 0")
def r28(spark, sf):
    k = F.col("doc_id")
    chunks = table(spark, sf, "documents").select(k.alias("chunk_id"), F.lit(1).alias("company_id"), k.alias("document_id"), F.lit(2).alias("section_id"), F.lit(2024).alias("fiscal_year"), F.concat(F.lit("Q"), k % 4).alias("fiscal_period"), F.col("lang").alias("text"), F.lit(3).alias("tokens"))
    chosen = chunks.filter("chunk_id % 2 = 0").select(F.col("chunk_id").cast("string").alias("chunk_id"), F.lit(1).alias("final_rank"))
    return I.chunk_evidence(chosen, chunks).select("label", "content", "period")


@query("st14_result_events", """WITH w AS (SELECT l_suppkey AS b, l_linenumber, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, repeat('warning ' || l_orderkey || ' ', 40)) AS n, repeat('warning ' || l_orderkey || ' ', 40)[1:240] AS t FROM lineitem WHERE l_linenumber = 1), s AS (SELECT b, count(*) AS n, list(t ORDER BY n) FILTER (n <= 10) AS t FROM w GROUP BY b),
o AS (SELECT l_suppkey AS b, count(*) AS n, count(DISTINCT l_returnflag) AS series FROM lineitem GROUP BY ALL)
SELECT s_suppkey AS branch_id, 'tool:' || s_suppkey || ':' || CASE WHEN s_suppkey % 4 = 0 THEN 'failed' ELSE 'completed' END || ':' || s_suppkey % 3 AS event_key, s_suppkey % 3 = 0 AS cache_hit, CASE WHEN s_suppkey % 4 > 0 THEN coalesce(o.n, 0) END AS n_observations, CASE WHEN s_suppkey % 4 > 0 THEN coalesce(series, 0) END AS series,
CASE WHEN s_suppkey % 4 > 0 THEN coalesce(s.n, 0) END AS n_warnings, CASE WHEN s_suppkey % 4 > 0 THEN coalesce(array_to_string(s.t, '|'), '') END AS warnings FROM supplier LEFT JOIN o ON o.b = s_suppkey LEFT JOIN s ON s.b = s_suppkey""")
def st14_results(spark, sf):
    """Suppliers as branches: their lines are observations, the first line of each order a long warning."""
    k = F.col("s_suppkey")
    outcomes = table(spark, sf, "supplier").select(F.lit("r").alias("run_id"), k.alias("branch_id"), F.lit("query_financial_facts").alias("kind"), F.when(k % 4 == 0, "failed").otherwise("completed").alias("status"), (k % 3).alias("attempts"))
    lines = table(spark, sf, "lineitem").select(F.lit("r").alias("run_id"), F.col("l_suppkey").alias("branch_id"), F.col("l_returnflag").alias("series"), "l_linenumber", F.col("l_orderkey").alias("place"), F.repeat(F.concat(F.lit("warning "), "l_orderkey", F.lit(" ")), F.lit(40)).alias("text"))
    return I.result_events(outcomes, lines, lines.filter("l_linenumber = 1")).withColumn("warnings", F.array_join("warnings", "|")).drop("run_id", "kind", "status")

"""Queries over evaluations and totals: documents are cases, labels their results, events operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.operators import evaluation as V, rollups as R
from ledgerlake.operators.retrieval import retrieval_quality
from ledgerlake.session import table

CASES = """c AS (SELECT d.doc_id AS case_id, d.doc_id AS ord, lang AS category, coalesce(quality = 1, false) AS passed, quality IS NULL AS missing, CASE WHEN quality IS NOT NULL THEN toxic = 0 END AS route, CASE WHEN d.doc_id % 3 = 0 AND quality IS NOT NULL THEN quality = 1 END AS company FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def cases(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("category"))
    joined, _ = V.joined_results(d, table(spark, sf, "labels").withColumnRenamed("doc_id", "case_id"))
    told = F.col("quality").isNotNull()
    return joined.select("case_id", "ord", "category", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("passed"), (~told).alias("missing"), F.when(told, F.col("toxic") == 0).alias("route"), F.when((F.col("case_id") % 3 == 0) & told, F.col("quality") == 1).alias("company"))


@query("a12_a24_case_metrics", f"""WITH {CASES} SELECT round(count(*) FILTER (WHERE passed) / count(*), 6) AS case_pass_rate, round(count(*) FILTER (WHERE missing) / count(*), 6) AS missing_rate, round(count(*) FILTER (WHERE route) / count(route), 6) AS route_accuracy, round(count(*) FILTER (WHERE company) / count(company), 6) AS company_accuracy FROM c""")
def a12(spark, sf):
    return V.case_metrics(cases(spark, sf))


@query("a13_by_category", f"WITH {CASES} SELECT category, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, round(count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate FROM c GROUP BY ALL")
def a13(spark, sf):
    return V.by_category(cases(spark, sf))


@query("j14_extra_results", "SELECT doc_id AS case_id FROM labels WHERE doc_id % 4 = 0")
def j14(spark, sf):
    golden = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id")).filter("case_id % 4 <> 0")
    return V.joined_results(golden, table(spark, sf, "labels").select(F.col("doc_id").alias("case_id")))[1]


@query("a14_gate_failures", f"""WITH {CASES}, m AS (SELECT round(count(*) FILTER (WHERE passed) / count(*), 6) AS p, round(count(*) FILTER (WHERE missing) / count(*), 6) AS q FROM c)
SELECT k AS metric, CASE WHEN k = 'case_pass_rate' AND p < 1.0 THEN 'below' WHEN k = 'missing_rate' AND q > 0.0 THEN 'above' WHEN k = 'latency' THEN 'missing' END AS failure FROM m, (VALUES ('case_pass_rate'), ('missing_rate'), ('latency')) t(k)""")
def a14(spark, sf):
    found = V.case_metrics(cases(spark, sf)).first().asDict()  # one row
    told = V.gate_failures(found, {"case_pass_rate": 1.0, "latency": 1.0}, {"missing_rate": 0.0})
    kinds = [(name, next(k for k in ("missing", "below", "above") if k in rest)) for name, rest in (t.split(": ") for t in told)]
    return spark.createDataFrame(kinds, "metric string, failure string")


@query("a15_budget_failures", """SELECT * FROM (SELECT doc_id AS case_id, concat_ws(',', CASE WHEN n_chars > 2000 THEN 'tokens_over_budget' END, CASE WHEN doc_id % 7 = 0 THEN 'tool_calls_missing' WHEN doc_id % 13 > 10 THEN 'tool_calls_over_budget' END) AS failures FROM documents) WHERE failures <> ''""")
def a15(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.col("n_chars").alias("tokens"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 13).alias("tool_calls"))
    return V.budget_failures(rows, {"tokens": 2000, "tool_calls": 10}).select("case_id", F.array_join("failures", ",").alias("failures"))


ROUTES = """r AS (SELECT user_id AS case_id, list_distinct(list(event_type) FILTER (WHERE event_id % 2 = 0)) AS tools, list_distinct(list(event_type) FILTER (WHERE event_id % 2 = 1 AND event_id % 3 > 0)) AS nodes FROM events GROUP BY ALL),
x AS (SELECT case_id, list_distinct(list_concat(coalesce(tools, []), coalesce(nodes, []))) AS e FROM r)"""


def routes(spark, sf):
    k = F.col("event_id")
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("case_id")).agg(
        F.collect_set(F.when(k % 2 == 0, F.col("event_type"))).alias("tools"),
        F.collect_list(F.when(k % 2 == 1, F.struct(F.col("event_type").alias("node"), F.when(k % 3 == 0, "skipped").otherwise("done").alias("status")))).alias("trajectory"),
    )
    return runs.select("case_id", V.executed_steps("tools", "trajectory").alias("executed"))


@query("a21_a23_required_tools", f"""WITH {ROUTES} SELECT case_id, CAST(len(e) AS BIGINT) AS n_executed, NOT list_contains(e, 'purchase') AS lacks, list_contains(e, 'error') AS used, list_contains(e, 'purchase') AND NOT list_contains(e, 'error') AS route_ok FROM x""")
def a21(spark, sf):
    got = V.required_and_prohibited(routes(spark, sf).withColumns({"required": F.array(F.lit("purchase")), "prohibited": F.array(F.lit("error"))}))
    return got.select("case_id", F.size("executed").cast("long").alias("n_executed"), (F.size("missing_tools") > 0).alias("lacks"), (F.size("used_prohibited") > 0).alias("used"), "route_ok")


@query("a22_matched_companies", """WITH o AS (SELECT c_nationkey AS case_id, c_custkey AS p, lower(c_name) AS m, 't' || c_custkey % 50 AS t, c_mktsegment AS s FROM customer),
k AS (SELECT case_id, p, s, m AS key FROM o UNION SELECT case_id, p, s, t FROM o), seen AS (SELECT * FROM k WHERE p % 3 = 0)
SELECT o.case_id, o.p AS position, (SELECT arg_min(b.p, (CASE WHEN b.s = o.s THEN 0 ELSE 1 END) * 1000000000 + b.p) FROM seen b WHERE b.case_id = o.case_id AND b.key IN (o.m, o.t)) AS observed_position FROM o""")
def a22(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("mention"), F.concat(F.lit("T"), F.col("c_custkey") % 50).alias("ticker"), F.col("c_mktsegment").alias("status"), F.lit("text").alias("source"))
    return V.matched_companies(rows, rows.filter("position % 3 = 0").withColumn("mention", F.upper("mention")))


@query("a25_observed_runs", """SELECT o_custkey AS case_id, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS operation, array_to_string(list_sort(list_distinct(list(left(o_orderpriority, 1)))), ',') AS tools, CAST(sum(greatest(0, o_orderkey % 4 - 1)) AS BIGINT) AS retries FROM orders GROUP BY ALL""")
def a25(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("operation"), (F.col("o_orderkey") % 4).alias("attempts"), F.left("o_orderpriority", F.lit(1)).alias("tool"))
    return V.observed_runs(rows).withColumn("tools", F.array_join("tools", ","))


@query("a26_golden_summary", "SELECT lang AS category, count(*) AS cases FROM documents GROUP BY ALL")
def a26(spark, sf):
    return V.golden_summary(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category")))


@query("a27_golden_faults", """SELECT doc_id % 190 AS case_id, 'repeated_id' AS fault FROM documents GROUP BY ALL HAVING count(*) > 1 UNION SELECT doc_id % 190, 'tools_overlap' FROM documents WHERE doc_id % 6 = 0 UNION SELECT doc_id % 190, 'no_category' FROM documents WHERE doc_id % 11 = 0""")
def a27(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select((k % 190).alias("case_id"), F.when(k % 11 == 0, " ").otherwise(F.lit("x")).alias("category"), F.array(F.when(k % 2 == 0, "sql").otherwise("web")).alias("required"), F.array(F.when(k % 3 == 0, "sql").otherwise("none")).alias("prohibited"))
    return V.golden_faults(rows)


@query("a10_retrieval_quality", """WITH r AS (SELECT 'dense' AS mode, label AS query, vec_id AS key FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'lexical', label, vec_id FROM embeddings WHERE vec_id % 3 = 0 AND label % 2 = 0),
e AS (SELECT label AS query, vec_id AS key FROM embeddings WHERE vec_id % 5 = 0), w AS (SELECT query, count(*) AS wanted FROM e GROUP BY ALL), m AS (SELECT DISTINCT mode FROM r),
h AS (SELECT mode, r.query, count(*) AS n, count(e.key) AS hits, count(*) FILTER (WHERE r.key % 10 = 0) AS copies FROM r LEFT JOIN e ON r.query = e.query AND r.key = e.key GROUP BY ALL)
SELECT m.mode, round(avg(coalesce(hits, 0) / wanted), 6) AS recall, round(avg(coalesce(hits / n, 0)), 6) AS precision, round(avg(coalesce(copies / n, 0)), 6) AS duplicate_rate FROM m CROSS JOIN w LEFT JOIN h ON h.mode = m.mode AND h.query = w.query GROUP BY m.mode""")
def a10(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("key"), (F.col("vec_id") % 10 == 0).alias("copy"))
    found = v.filter("key % 2 = 0").withColumn("mode", F.lit("dense")).unionByName(v.filter("key % 3 = 0 and query % 2 = 0").withColumn("mode", F.lit("lexical")))
    got = retrieval_quality(found, v.filter("key % 5 = 0").drop("copy"))
    return got.select("mode", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "duplicate_rate")])


@query("a1_corpus_stats", """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS chunks, (SELECT CAST(sum(length(url)) AS BIGINT) FROM pages) AS tokens, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(DISTINCT label) FROM embeddings) AS embedded, round((SELECT count(DISTINCT label) FROM embeddings) / (SELECT count(*) FROM pages), 4) AS embedded_rate""")
def a1(spark, sf):
    chunks = table(spark, sf, "pages").select(F.col("page_id").alias("chunk_id"), F.length("url").cast("long").alias("token_count"))
    return R.corpus_stats(table(spark, sf, "documents"), chunks, table(spark, sf, "embeddings").select(F.col("label").alias("chunk_id")))


@query("a8_processing_rollup", """SELECT lang, count(*) AS versions, count(*) FILTER (WHERE doc_id % 5 > 1) AS processed, count(*) FILTER (WHERE doc_id % 5 = 0) AS skipped, count(*) FILTER (WHERE doc_id % 5 = 1) AS failed, CAST(sum(n_chars) AS BIGINT) AS candidates, CAST(sum(n_chars // 2) AS BIGINT) AS kept, round(sum(n_chars - n_chars // 2) / sum(n_chars), 4) AS removed_rate FROM documents GROUP BY ALL""")
def a8(spark, sf):
    k = F.col("doc_id") % 5
    rows = table(spark, sf, "documents").select("lang", F.when(k == 0, "skipped").when(k == 1, "failed").otherwise("processed").alias("status"), F.col("n_chars").alias("candidates"), F.expr("n_chars div 2").alias("kept"))
    return R.processing_rollup(rows, ["lang"])


@query("a16_calculation_evidence", """SELECT o_custkey AS branch_id, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS company, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS metric, CAST(min(o_orderdate) AS DATE) AS period_start, CAST(max(o_orderdate) AS DATE) AS period_end, CASE WHEN count(*) = 1 THEN min(o_totalprice) END AS value, count(*) AS n_points FROM orders GROUP BY ALL""")
def a16(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return R.calculation_evidence(table(spark, sf, "orders").select(F.col("o_custkey").alias("branch_id"), F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("metric"), day.alias("period_start"), day.alias("period_end"), F.col("o_totalprice").alias("value")))


@query("a18_newest_runs", "SELECT event_id, ts, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def a18(spark, sf):
    return R.newest_runs(table(spark, sf, "events").select("event_id", "ts"), "event_id", "ts", 50)


@query("a19_model_usage", "SELECT event_type, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens, round(sum(CAST(value AS DECIMAL(18, 4))), 4)::DOUBLE AS cost FROM events GROUP BY ALL")
def a19(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("user_id").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"), F.col("value").cast("decimal(18,4)").alias("cost"))
    return R.usage(rows, ["event_type"]).withColumn("cost", F.col("cost").cast("double"))


@query("a20_telemetry", "SELECT event_type AS operation, CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CAST(CASE WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 WHEN value <= 200 THEN 200.0 END AS DOUBLE) AS upper_bound, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def a20(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("operation"), F.when(F.col("event_id") % 9 == 0, "error").otherwise("ok").alias("status"), F.col("value").alias("duration"))
    return R.telemetry(rows, (10, 50, 200)).withColumn("total", F.round("total", 4))


@query("a6_available_units", "SELECT o_custkey AS company_id, array_to_string(list_sort(list_distinct(list(left(o_orderpriority, 1)))), ',') AS units FROM orders GROUP BY ALL")
def a6(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.left("o_orderpriority", F.lit(1)).alias("unit"))
    return R.available_units(rows, ["company_id"]).withColumn("units", F.array_join("units", ","))

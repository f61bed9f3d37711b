"""Queries over answers, their claims and evidence, made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.operators import claims as C
from ledgerlake.session import table

A = """e AS (SELECT o_custkey AS answer_id, o_orderkey AS id, 'fact:' || o_orderkey AS evidence_id, o_orderkey % 8 AS b, CAST(round(o_totalprice) AS BIGINT) AS v, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
s AS (SELECT *, CASE WHEN b = 4 THEN 'Trend rose.' ELSE 'Firm ' || answer_id % 4 || ' Inc. made ' || CASE WHEN b = 3 THEN 2 * v + 7 ELSE v END || CASE WHEN b = 6 THEN ' percent' ELSE ' usd' END || ' in ' || CASE WHEN b = 1 THEN y + 9 ELSE y END || CASE WHEN b = 5 THEN ' due to rates.' ELSE '.' END END AS text FROM e)"""


def evidence(spark, sf):
    key, b = F.col("o_orderkey"), F.col("o_orderkey") % 8
    lost = F.when(b == 7, F.array(F.lit("fact:gone"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("answer_id"), F.concat(F.lit("fact:"), key).alias("evidence_id"), F.when(b.isin(5, 7), "calculation").otherwise("fact").alias("kind"), F.lit("Total of orders").alias("summary"),
        F.concat(F.lit("Firm "), F.col("o_custkey") % 4).alias("company_name"), F.year("o_orderdate").alias("fiscal_year"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"),
        F.lit("USD").alias("unit"), F.round("o_totalprice").cast("long").alias("value"), F.lit(None).cast("string").alias("formula"), F.when(b == 5, "correlation").alias("operation"), lost.alias("lineage_refs"),
        F.array((F.col("o_custkey") % 4).cast("double")).alias("amounts"), key.alias("_key"),
    )


def answers(spark, sf):
    """A sentence an order: b 1 wrong year, 2 unknown id, 3 wrong number, 4 uncited, 5 a cause from correlation, 6 wrong unit, 7 lost lineage."""
    b, who = F.col("_key") % 8, F.col("answer_id")
    plain = F.concat(
        F.lit("Firm "), who % 4, F.lit(" Inc. made "), F.when(b == 3, 2 * F.col("value") + 7).otherwise(F.col("value")), F.when(b == 6, " percent").otherwise(" usd"), F.lit(" in "), F.when(b == 1, F.col("fiscal_year") + 9).otherwise(F.col("fiscal_year")),
        F.when(b == 5, " due to rates").otherwise(""), F.when(b == 2, F.lit(". [fact:none]")).otherwise(F.concat(F.lit(" ["), "evidence_id", F.lit("]."))),
    )
    told = F.struct("_key", F.when(b == 4, F.lit("Trend rose.")).otherwise(plain).alias("t"))
    return evidence(spark, sf).groupBy("answer_id").agg(F.array_sort(F.collect_list(told)).alias("s")).select("answer_id", F.concat(F.lit("## Answer\n\n"), F.array_join(F.transform("s", lambda x: x["t"]), " ")).alias("answer"))


@query("c1_c2_claims", f"WITH {A} SELECT answer_id, i AS sentence_index, text, 'claim:' || substr(sha256(i || ':' || text), 1, 16) AS claim_id, CASE b WHEN 4 THEN '' WHEN 2 THEN 'fact:none' ELSE evidence_id END AS cited, true AS material FROM s")
def c1(spark, sf):
    return C.claims(answers(spark, sf)).select("answer_id", "sentence_index", "text", "claim_id", F.array_join("evidence_ids", ",").alias("cited"), "material")


@query("c6_c7_c8_c9_c10_issues", f"""WITH {A} SELECT answer_id, i AS sentence_index, CASE b WHEN 1 THEN 'wrong_period' WHEN 2 THEN 'unknown_citations' WHEN 3 THEN 'unsupported_number' WHEN 4 THEN 'unsupported_claim' WHEN 5 THEN 'correlation_as_causation' WHEN 6 THEN 'wrong_unit' ELSE 'incomplete_calculation_lineage' END AS code FROM s WHERE b > 0""")
def c6(spark, sf):
    rows = C.claims(answers(spark, sf))
    wrong = C.issues(rows, evidence(spark, sf).drop("_key"))
    return rows.select("answer_id", "claim_id", "sentence_index").join(wrong, ["answer_id", "claim_id"]).select("answer_id", "sentence_index", "code")


@query("c6_answers_valid", f"WITH {A} SELECT answer_id, count(*) AS n_claims, count(*) FILTER (WHERE b = 0) AS n_supported, bool_and(b = 0) AS valid FROM s GROUP BY answer_id")
def c6_valid(spark, sf):
    return C.answers_valid(C.claims(answers(spark, sf)), evidence(spark, sf).drop("_key"))


@query("c16_citations", f"WITH {A} SELECT answer_id, evidence_id, 'Total of orders' AS label, 'claim:' || substr(sha256(i || ':' || text), 1, 16) AS claim_ids FROM s WHERE b NOT IN (2, 4)")
def c16(spark, sf):
    found = C.citation_list(C.claims(answers(spark, sf)), evidence(spark, sf).drop("_key"))
    return found.withColumn("claim_ids", F.array_join("claim_ids", ","))


@query("c4_conflicting_ids", "SELECT o_custkey AS answer_id, 'k' || o_orderkey % 5 AS evidence_id, count(DISTINCT o_orderpriority) AS n_bodies FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1")
def c4(spark, sf):
    return C.conflicting_ids(table(spark, sf, "orders").select(F.col("o_custkey").alias("answer_id"), F.concat(F.lit("k"), F.col("o_orderkey") % 5).alias("evidence_id"), F.col("o_orderpriority").alias("summary")))


@query("c5_source_previews", "SELECT page_id AS answer_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '#.*$', '') || '#page=' || page_id WHEN page_id % 3 = 1 THEN regexp_replace(url, '#.*$', '') || '#section=s' || page_id ELSE url END AS exact_url, 'unchecked' AS status FROM pages WHERE regexp_matches(url, '^https?://[^/?#]') UNION ALL SELECT page_id, 'x' || url, 'invalid' FROM pages WHERE url IS NOT NULL")
def c5(spark, sf):
    key = F.col("page_id")
    rows = table(spark, sf, "pages").filter(F.col("url").rlike("^https?://[^/?#]") | F.col("url").isNotNull())
    good = F.filter(F.array(F.when(F.col("url").rlike("^https?://[^/?#]"), F.col("url")), F.concat(F.lit("x"), "url")), lambda u: u.isNotNull())
    rows = rows.select(key.alias("answer_id"), F.lit("e").alias("evidence_id"), F.when(key % 3 == 0, key).alias("page_start"), F.when(key % 3 == 1, F.concat(F.lit("s"), key)).alias("section_id"), good.alias("source_urls"))
    return C.source_previews(rows).select("answer_id", "exact_url", "status")


@query("c13_expanded_lineage", "SELECT o_custkey AS answer_id, 'calculation:c' AS evidence_id, string_agg('financial_fact:' || o_orderkey, ',' ORDER BY 'financial_fact:' || o_orderkey) AS refs FROM orders WHERE o_orderkey % 3 < 2 GROUP BY o_custkey")
def c13(spark, sf):
    orders = table(spark, sf, "orders")
    rows = C.assembled({"financial_fact": orders.select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("fact_id"), F.concat(F.lit("b"), F.col("o_orderkey") % 3).alias("branch_id"))})
    calls = orders.select(F.col("o_custkey").alias("answer_id")).distinct().select("answer_id", F.lit("calculation:c").alias("evidence_id"), F.array(F.lit("b0"), F.lit("b1")).alias("input_branches"))
    return C.expanded_lineage(calls, rows).select("answer_id", "evidence_id", F.array_join("lineage_refs", ",").alias("refs"))


@query("c14_fact_table", """WITH f AS (SELECT o_custkey AS answer_id, CAST(year(o_orderdate) AS VARCHAR) AS period, 'revenue' AS metric, 'F' || o_orderkey % 3 AS c, CAST(o_orderkey AS VARCHAR) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT answer_id, period, metric, min_by(d, n) FILTER (WHERE c = 'F0') AS F0, min_by(d, n) FILTER (WHERE c = 'F1') AS F1, min_by(d, n) FILTER (WHERE c = 'F2') AS F2 FROM f WHERE n <= 12 GROUP BY ALL""")
def c14(spark, sf):
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("answer_id"), F.year("o_orderdate").cast("string").alias("period"), F.lit("revenue").alias("metric"), F.concat(F.lit("F"), key % 3).alias("company_name"), key.cast("string").alias("display"), key.alias("position"))
    return C.fact_table(rows, ["F0", "F1", "F2"])


@query("c11_judged", f"WITH {A} SELECT answer_id, i AS sentence_index FROM s WHERE text LIKE '%% made 1%%'".replace("%%", "%"))
def c11(spark, sf):
    """A judge that rejects every sum that begins with a one."""
    rows = C.claims(answers(spark, sf))

    def judge(claims, evidence):
        return claims.filter(F.col("text").contains(" made 1")).select("answer_id", "claim_id", F.lit("judged").alias("code"), F.lit(None).cast("string").alias("evidence_id"))

    wrong = C.issues(rows, evidence(spark, sf).drop("_key"), judge=judge).filter("code = 'judged'")
    return rows.select("answer_id", "claim_id", "sentence_index").join(wrong, ["answer_id", "claim_id"]).select("answer_id", "sentence_index")

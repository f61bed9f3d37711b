"""Queries over documents, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.functions import embed as E, text as T
from ledgerlake.operators import documents as D, retrieval as R
from ledgerlake.plans.requests import RetrievalRequest
from ledgerlake.session import table


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@query("p5_f1_normalise", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10))) AS hash FROM documents""")
def p5(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_hash(T.normalise_document(F.coalesce("text", F.lit("")))).alias("hash"))


@query("f7_fingerprint_text", "SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS hash FROM documents WHERE text IS NOT NULL")
def f7(spark, sf):
    return docs(spark, sf).filter("text is not null").select("doc_id", T.content_hash(T.fingerprint_text("text")).alias("hash"))


@query("f8_shingles", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM w) SELECT doc_id, CAST(len(list_distinct(s)) AS BIGINT) AS n_shingles, list_min(s) AS first_shingle FROM s")
def f8(spark, sf):
    return docs(spark, sf).filter("text is not null").select("doc_id", T.shingles("text").alias("s")).select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.array_min("s").alias("first_shingle"))


@query("f12_f14_tokens_preview", r"""WITH p AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS flat FROM documents WHERE text IS NOT NULL)
SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens, CASE WHEN length(flat) <= 360 THEN flat ELSE trim(CASE WHEN contains(flat[1:360], ' ') THEN regexp_replace(flat[1:360], ' [^ ]*$', '') ELSE flat[1:360] END) || '...' END AS preview FROM p""")
def f12(spark, sf):
    return docs(spark, sf).filter("text is not null").select("doc_id", T.rough_tokens("text").alias("tokens"), T.preview("text").alias("preview"))


@query("p9_p10_flags", r"""SELECT item_id, regexp_matches(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' '), 'forward looking statements|actual results may differ materially|safe harbor|not undertake any obligation to update|all rights reserved|non gaap financial measures|not a solicitation') AS boilerplate, CAST(regexp_matches(text, '(?i)system\s+prompt') AS BIGINT) AS flags FROM benchmark""")
def p9(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.is_boilerplate("text").alias("boilerplate"), F.size(T.injection_flags("text")).cast("long").alias("flags"))


@query("p11_redact", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\b(?:sk|pk)-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g'), '(?i)\b(api[_-]?key|token|password|secret)\s*[=:]\s*[^\s,;]+', '\1=[REDACTED]', 'g'), '(?i)(https?://[^:/\s]+:)[^@/\s]+@', '\1[REDACTED]@', 'g')) AS hash FROM documents WHERE text IS NOT NULL""")
def p11(spark, sf):
    return docs(spark, sf).filter("text is not null").select("doc_id", T.content_hash(T.redacted("text")).alias("hash"))


@query("p12_url_allowlist", "SELECT page_id, regexp_matches(url, '^https://([a-z0-9.-]+\\.)?example\\.(org|com)(/|\\?|#|$)') AS allowed FROM pages WHERE url IS NOT NULL")
def p12(spark, sf):
    return table(spark, sf, "pages").filter("url is not null").select("page_id", T.url_allowed("url", ("example.org", "example.com")).alias("allowed"))


@query("f3_f4_joined_hash", "SELECT event_id, sha256(coalesce(CAST(event_id AS VARCHAR), '') || '|' || coalesce(event_type, '') || '|' || coalesce(CAST(user_id AS VARCHAR), '')) AS hash FROM events")
def f3(spark, sf):
    return table(spark, sf, "events").select("event_id", T.joined_hash("event_id", "event_type", "user_id").alias("hash"))


@query("f19_t3_dense_top_k", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM s ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 20""")
def f19(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = vectors.filter("vec_id = 0").first()["embedding"]
    return R.dense(vectors, wanted, 20, key="vec_id").select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r7_t4_lexical_top_k", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'thst', 'that'))) / len(w) AS score FROM w WHERE len(w) > 0)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM s WHERE score > 0 ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20""")
def r7(spark, sf):
    return R.lexical(docs(spark, sf), "The thst that the", 20, key="doc_id").select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r9_j11_fusion", """WITH a AS (SELECT vec_id AS k, row_number() OVER (ORDER BY list_sum(embedding[1:8]) DESC, vec_id) AS rank FROM embeddings), b AS (SELECT vec_id AS k, row_number() OVER (ORDER BY embedding[9] DESC, vec_id) AS rank FROM embeddings)
SELECT coalesce(x.k, y.k) AS chunk_id, round(coalesce(1.0 / (60 + x.rank), 0) + coalesce(1.0 / (60 + y.rank), 0), 9) AS score FROM (SELECT * FROM a WHERE rank <= 50) x FULL JOIN (SELECT * FROM b WHERE rank <= 50) y ON x.k = y.k""")
def r9(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda s, x: s + x.cast("double")).alias("x"), F.col("embedding")[8].cast("double").alias("y"))
    best = lambda c: R.top_k(v.select("chunk_id", F.col(c).alias("score")), "score", "chunk_id", 50)
    return R.fused(best("x"), best("y")).select("chunk_id", F.round("score", 9).alias("score"))


@query("f20_hashed_embedding", r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), s AS (SELECT item_id, ('0x' || substr(sha256(w), 1, 16))::UBIGINT % 384 AS slot, CASE WHEN ('0x' || substr(sha256(w), 17, 2))::UBIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM t),
v AS (SELECT item_id, slot, sum(sign) AS x FROM s GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS len FROM v GROUP BY ALL) SELECT item_id, CAST(slot AS BIGINT) AS slot, round(x / CASE WHEN len = 0 THEN 1 ELSE len END, 6) AS value FROM v JOIN n USING (item_id) WHERE x <> 0""")
def f20(spark, sf):
    got = E.hashed_embedding(table(spark, sf, "benchmark").select("item_id", "text"), "item_id", "text")
    return got.select("item_id", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0").select("item_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


@query("d8_near_pairs", """WITH d AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM d),
s AS (SELECT id, list_distinct(CASE WHEN len(w) < 5 THEN w ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w WHERE len(w) > 0),
x AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s), p AS (SELECT a.id AS a, b.id AS b, count(*) AS n_both, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, round(n_both / (na + nb - n_both), 6) AS jaccard FROM p WHERE n_both / (na + nb - n_both) >= 0.8""")
def d8(spark, sf):
    return D.near_pairs(docs(spark, sf).filter("text is not null"), "doc_id", "text", 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("d8_text_classes", "SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS class_id, CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_equal FROM documents")
def d8_classes(spark, sf):
    """The rows that d8_near_pairs names by one id: each document with the smallest id of its equal texts."""
    return D.text_classes(docs(spark, sf), "doc_id", "text")


def versions(spark, sf):
    """The lines of each document that aren't blank, as chunks of a version."""
    lines = F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("chunk_index", "text")
    return docs(spark, sf).filter("text is not null").select(F.col("doc_id").alias("version"), lines)


@query("d8_greedy_decisions")
def d8_greedy(spark, sf):
    # a version is a document's own chunks: bounded by the document, however many there are
    rows = versions(spark, sf)
    return D.drop_near_copies(rows, "version", "chunk_index", "text", 0.9).select("version", "chunk_index", "decision")


@query("d5_d6_chunks")
def d5(spark, sf):
    return D.chunks(docs(spark, sf), "doc_id", "text")


@query("d7_summaries")
def d7(spark, sf):
    return D.summaries(docs(spark, sf), "doc_id", "text")


@query("s13_s14_html_text")
def s13(spark, sf):
    from ledgerlake.functions.udfs import html_texts

    return table(spark, sf, "pages").select("page_id", html_texts("html").alias("_t")).select("page_id", "_t.*")


@query("s15_sections")
def s15(spark, sf):
    from ledgerlake.functions.udfs import detect_sections, html_text

    return table(spark, sf, "pages").select("page_id", detect_sections(html_text("html")).alias("sections"))


@query("r5_hybrid_retrieval")
def r5(spark, sf):
    chunks = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 97).alias("document_id"), "text", F.col("lang").alias("period"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = vectors.filter("_v = 0").first()["embedding"]
    return R.retrieve(chunks.join(vectors, F.col("chunk_id") == F.col("_v"), "left"), RetrievalRequest("the thst that", per_period=6), wanted)


@query("a2_documents_by_kind", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def a2(spark, sf):
    return docs(spark, sf).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("a11_citation_metrics", """WITH p AS (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 3 <> 0), e AS (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 5 <> 0), j AS (SELECT p.doc_id AS p, e.doc_id AS e FROM p FULL JOIN e ON p.doc_id = e.doc_id)
SELECT count(*) FILTER (WHERE p IS NOT NULL AND e IS NOT NULL) AS true_positives, count(*) FILTER (WHERE e IS NULL) AS false_positives, count(*) FILTER (WHERE p IS NULL) AS false_negatives,
round(count(*) FILTER (WHERE p IS NOT NULL AND e IS NOT NULL) / count(p), 6) AS precision, round(count(*) FILTER (WHERE p IS NOT NULL AND e IS NOT NULL) / count(e), 6) AS recall FROM j""")
def a11(spark, sf):
    from ledgerlake.operators.evaluation import citation_metrics

    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("evidence_id"))
    return citation_metrics(good.filter("claim_id % 3 <> 0"), good.filter("claim_id % 5 <> 0"))


@query("st3_rate_limit", """WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 3600 ORDER BY ts, event_id) AS n FROM events) SELECT event_id, n <= 2 AS accepted FROM r""")
def st3(spark, sf):
    from ledgerlake.streaming.events import rate_limited

    return rate_limited(table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "event_id", 3600, 2).select("event_id", "accepted")


@query("st1_cursor_page", "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 100")
def st1(spark, sf):
    from ledgerlake.streaming.events import page

    return page(table(spark, sf, "events"), "event_id", 100, 100).select("event_id", "event_type")

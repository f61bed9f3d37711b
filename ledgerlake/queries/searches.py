"""Queries that ask for the whole benchmark at once, and over an inverted file of vectors."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ledgerlake.catalogue import query
from ledgerlake.functions import embed as E, text as T
from ledgerlake.operators import search as S
from ledgerlake.plans.requests import RetrievalRequest
from ledgerlake.session import stored, table


def corpus(spark, sf):
    """Every document as a chunk with its hashed vector."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 97).alias("document_id"), "text", F.col("lang").alias("period"))
    return docs.join(E.hashed_embedding(docs.select(F.col("chunk_id").alias("_c"), "text"), "_c", "text"), F.col("chunk_id") == F.col("_c")).drop("_c")


def asked(spark, sf):
    """Every item of the benchmark as a query."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return items.join(E.hashed_embedding(items.select(F.col("query").alias("_q"), "text"), "_q", "text"), F.col("query") == F.col("_q")).select(F.col("query").cast("string").alias("query"), "text", F.col("embedding").alias("vector"))


def wanted(spark, sf):
    """(query, key): the texts that hold the first five words of an item."""
    first = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.array_join(F.slice(T.fingerprint_words("text"), 1, 5), " ").alias("s"))
    held = table(spark, sf, "documents").filter("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), F.explode(T.shingles("text")).alias("_s"))
    return first.join(held, F.col("s") == F.col("_s")).select("query", "key").distinct()


_RANKED = """WITH words AS (SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM benchmark),
n AS (SELECT kind, id, w, count(*) AS n FROM words GROUP BY ALL), token AS (SELECT w, ('0x' || substr(sha256(w), 1, 16))::UBIGINT % 384 AS slot, CASE WHEN ('0x' || substr(sha256(w), 17, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT w FROM n)),
v AS (SELECT kind, id, slot, sum(sign * n) AS x FROM n JOIN token USING (w) GROUP BY ALL), len AS (SELECT kind, id, sqrt(sum(x * x)) AS len FROM v GROUP BY ALL),
dot AS (SELECT b.id AS q, d.id AS c, sum(b.x * d.x) AS dot FROM v b JOIN v d ON b.kind = 'b' AND d.kind = 'd' AND b.slot = d.slot GROUP BY ALL),
cosine AS (SELECT item_id AS q, doc_id AS c, coalesce(round(dot / nullif(lb.len * ld.len, 0), 9), 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN dot ON q = item_id AND c = doc_id LEFT JOIN len lb ON lb.kind = 'b' AND lb.id = item_id LEFT JOIN len ld ON ld.kind = 'd' AND ld.id = doc_id),
size AS (SELECT id, sum(n) AS size FROM n WHERE kind = 'd' GROUP BY id), share AS (SELECT b.id AS q, d.id AS c, round(sum(d.n) / any_value(size), 9) AS score FROM n b JOIN n d ON b.kind = 'b' AND d.kind = 'd' AND b.w = d.w JOIN size ON size.id = d.id GROUP BY b.id, d.id),
a AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(c AS VARCHAR)) AS r FROM cosine QUALIFY r <= 50), b AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(c AS VARCHAR)) AS r FROM share QUALIFY r <= 50),
f AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.c, b.c) AS c, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score FROM a FULL JOIN b ON a.q = b.q AND a.c = b.c),
every AS (SELECT 'dense' AS mode, q, c, score FROM a UNION ALL SELECT 'lexical', q, c, score FROM b UNION ALL SELECT 'hybrid', q, c, score FROM f),
top AS (SELECT mode, q, c, row_number() OVER (PARTITION BY mode, q ORDER BY score DESC, CAST(c AS VARCHAR)) AS rank FROM every QUALIFY rank <= 10)"""


def _top(spark, sf):
    rank = F.row_number().over(W.partitionBy("mode", "query").orderBy(F.desc("score"), "chunk_id"))
    return S.ranked_modes(stored(corpus(spark, sf)), stored(asked(spark, sf))).withColumn("rank", rank).filter("rank <= 10")


@query("r25_ranked_modes", f"{_RANKED} SELECT mode, CAST(q AS VARCHAR) AS query, CAST(c AS VARCHAR) AS chunk_id, rank FROM top")
def r25_ranked(spark, sf):
    """The best ten chunks of every item by cosine, words and both."""
    return _top(spark, sf).select("mode", "query", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("r25_compared_modes", f"""{_RANKED}, hold AS (SELECT sha256(text) AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), sh AS (SELECT DISTINCT key, unnest(CASE WHEN len(w) < 5 THEN w ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM hold),
e AS (SELECT DISTINCT item_id AS q, key FROM benchmark JOIN sh ON s = array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:5], ' ')), got AS (SELECT mode, q, sha256(text) AS key, row_number() OVER (PARTITION BY mode, q, sha256(text)) > 1 AS copy FROM top JOIN documents ON doc_id = c),
h AS (SELECT mode, got.q, count(*) AS n, count(e.key) AS hits, count(*) FILTER (WHERE copy) AS copies FROM got LEFT JOIN e ON e.q = got.q AND e.key = got.key GROUP BY mode, got.q), want AS (SELECT q, count(*) AS wanted FROM e GROUP BY q), m AS (SELECT DISTINCT mode FROM top)
SELECT m.mode, avg(coalesce(hits, 0) / wanted) AS recall, avg(coalesce(hits / n, 0)) AS precision, avg(coalesce(copies / n, 0)) AS duplicate_rate FROM m CROSS JOIN want LEFT JOIN h ON h.mode = m.mode AND h.q = want.q GROUP BY m.mode""")
def r25_compared(spark, sf):
    names = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return S.compared(stored(_top(spark, sf).select("mode", "query", "chunk_id")), names, stored(wanted(spark, sf)))


@query("r5_r25_retrieved_modes")
def r25_retrieved(spark, sf):
    """Copies dropped and documents capped, greedily; tests compare with `retrieve`, which ranks for one query."""
    return S.retrieve_many(stored(corpus(spark, sf)), stored(asked(spark, sf)), RetrievalRequest("every item of the benchmark"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def probing(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").cast("array<double>").alias("vector"))


@query("r6_index_all_lists", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS q, c.vec_id AS c, round(list_cosine_similarity(q.e, c.e), 9) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0)
SELECT CAST(q AS VARCHAR) AS query, CAST(c AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(c AS VARCHAR)) AS rank FROM s QUALIFY rank <= 20""")
def r6_all(spark, sf):
    """Every list probed: the result is that of the exact search."""
    index = S.build_index(vectors(spark, sf), lists=8)
    return S.search_index(spark, index, probing(spark, sf), 20, probes=8).select("query", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("r6_index_recall")
def r6_recall(spark, sf):
    """How many of the exact 20 of each query an index finds, over 9 of its 16 lists (these vectors have no clusters); tests ask for 0.95 on average."""
    index = S.build_index(vectors(spark, sf), lists=16)
    found = S.search_index(spark, index, probing(spark, sf), 20, probes=9)
    return S.index_recall(found, S.dense_many(vectors(spark, sf), probing(spark, sf), 20))

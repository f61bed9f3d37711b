"""One query for each operator, over its whole table with production parameters, with SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.packing import crc_of, pack

    return crc_of(pack(table(spark, sf_dir, "documents"), tokenizer()))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.rules import judge

    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.simhash import components

    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.substring import remove_repeats, removed_words

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", removed_words().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.chat import digests, formatted

    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(formatted(rows.unionByName(more), tokenizer()))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.urls import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.maxent import score

    return score(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op9_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS src, vec_id AS dst FROM v UNION SELECT r.src, l.b FROM reach r JOIN link l ON r.dst = l.a),
comp AS (SELECT src, min(dst) AS component_id FROM reach GROUP BY src)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, p.component_id, v.vec_id = p.component_id AS kept
FROM v JOIN comp p ON v.vec_id = p.src LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) c ON v.vec_id = c.a
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.bpe import digest, encode

    return digest(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(), decoded="decoded"))


QUERIES |= {"op2_quality_classifier": op2_quality_classifier, "op4_quality_rules": op4_quality_rules, "op5_simhash": op5_simhash}
QUERIES |= {"op6_chat": op6_chat, "op7_url_filters": op7_url_filters, "op8_lm_scoring": op8_lm_scoring, "op9_embeddings": op9_embeddings}
QUERIES |= {"op1_packing": op1_packing, "op3_substring_dedup": op3_substring_dedup, "op10_bpe": op10_bpe}

ORACLES["op3_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM rep, (SELECT unnest(generate_series(0, 34)) AS k)),
pos AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.pos) AS kept
  FROM pos p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r AND len(a.q) = len(c.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.ar = n.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

QUERIES |= {"op11_hard_negatives": op11_hard_negatives}


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int = 10) -> str:
    """The rounds unrolled, each a table of centroids (c, q) from the one before."""
    near = "SELECT v.r, v.vec_id, v.q, arg_min(k.c, (list_inner_product(v.q, v.q) + list_inner_product(k.q, k.q) - 2 * list_inner_product(v.q, k.q)) * 1000 + k.c) AS cluster FROM v, c{n} k GROUP BY v.r, v.vec_id, v.q"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(f"s{n} AS (SELECT cluster AS c, i, floor(sum(x) / count(*)) AS x FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY ALL)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{n} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM s{n} GROUP BY c) m ON o.c = m.c)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 8)),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(n=rounds)}),
d AS (
  SELECT l.vec_id, l.cluster, list_inner_product(l.q, l.q) + list_inner_product(k.q, k.q) - 2 * list_inner_product(l.q, k.q) AS distance,
         sha256(array_to_string(list_transform(k.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
  FROM last l JOIN c{rounds} k ON l.cluster = k.c)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM d
"""


ORACLES["op13_centroid_clustering"] = _lloyd_sql()

QUERIES |= {"op13_centroid_clustering": op13_centroid_clustering}


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlake.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


ORACLES["op12_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""

QUERIES |= {"op12_warc": op12_warc}

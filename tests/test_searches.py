"""Retrieval of many queries at once against one query at a time and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import retrieval as R, search as S
from ledgerlake.plans.requests import RetrievalRequest
from ledgerlake.queries import searches as Q
from ledgerlake.session import stored

TEXTS = ["alpha beta gamma", "alpha alpha", None, "", "delta. Alpha-beta", "beta " * 50, "gamma alpha beta beta", "alpha alpha", "é alpha", "beta beta alpha", "zeta"]


def odd_chunks(spark):
    rng = np.random.default_rng(8)
    vectors = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(30)]
    vectors[3], vectors[4], vectors[5], vectors[6] = None, [0.0] * 4, [None, 1.0, 0.0, 2.0], [1.0, 2.0]
    rows = [(k, k % 5, TEXTS[k % len(TEXTS)], f"p{k % 3}", v) for k, v in enumerate(vectors)] + [(None, 1, "alpha", "p0", [1.0] * 4)]
    return rows, spark.createDataFrame(rows, "chunk_id long, document_id long, text string, period string, embedding array<double>").withColumn("score", F.lit("clash"))


QUERIES = [("a", "alpha beta", [1.0, 0.0, -1.0, 2.0]), ("b", "Beta", [1.0, 2.0]), ("c", "nothing here", [0.0] * 4), ("d", "gamma gamma alpha", [2.0, 2.0, 1.0, 1.0]), ("e", "", None), (None, "alpha", [1.0] * 4)]


def brute_dense(rows, vector, k):
    out = []
    for key, *_, v in rows:
        if key is None or v is None:
            continue
        v = [x or 0.0 for x in v]
        scale = np.linalg.norm(v) * np.linalg.norm(vector)
        out.append((-round(sum(a * b for a, b in zip(v, vector)) / scale, 9) + 0.0 if scale else 0.0, str(key)))
    return [(key, r + 1) for r, (_, key) in enumerate(sorted(out)[:k])]


@pytest.mark.parametrize("most", [1024, 2])
def test_many_queries_rank_as_one(spark, monkeypatch, most):
    monkeypatch.setattr(S, "query_blocks", lambda q, c, f=S.query_blocks: f(q, c, most))
    rows, chunks = odd_chunks(spark)
    queries = spark.createDataFrame(QUERIES, "query string, text string, vector array<double>")
    dense = {q: [] for q, *_ in QUERIES}
    for r in sorted(S.dense_many(chunks.repartition(4), queries, 7).collect(), key=lambda r: r["rank"]):
        dense[r.query].append((r.chunk_id, r["rank"]))
    assert dense == {q: brute_dense(rows, v, 7) if v is not None and q else [] for q, _, v in QUERIES}
    words = S.lexical_many(chunks.repartition(4), queries, 7)
    got = {(r.query, r.chunk_id, r["rank"]) for r in words.collect()}
    pool = chunks.filter("chunk_id is not null")
    assert got == {(q, str(r.chunk_id), r["rank"]) for q, t, _ in QUERIES if q and t for r in R.lexical(pool, t, 7).collect()} and len(got) > 20
    assert S.dense_many(chunks.filter("false"), queries, 3).count() == S.lexical_many(chunks, queries.filter("false"), 3).count() == 0


def test_retrieved_modes_equal_single_retrieval(spark):
    _, chunks = odd_chunks(spark)
    chunks = stored(chunks.filter("chunk_id <> 5 and size(embedding) = 4").drop("score"))
    queries = spark.createDataFrame([q for q in QUERIES if q[0] in ("a", "d")], "query string, text string, vector array<double>")
    request = RetrievalRequest("x", top_k=6, per_document=2)
    got = {}
    for r in S.retrieve_many(chunks, queries, request).collect():
        got.setdefault((r.mode, r.query), {})[r.final_rank] = r.chunk_id
    want = {}
    for q, t, v in QUERIES:
        if q in ("a", "d"):
            for mode in ("dense", "lexical", "hybrid"):
                rows = R.retrieve(chunks, RetrievalRequest(t, mode=mode, top_k=6, per_document=2), v).collect()
                want[mode, q] = {r.final_rank: r.chunk_id for r in rows}
    assert got == want


def test_merge_by_tree_keeps_the_best(spark):
    rng = np.random.default_rng(9)
    rows = [("q", str(k), float(rng.integers(0, 20)), int(k % 150)) for k in range(900)]
    got = S.merged(spark.createDataFrame(rows, S.FOUND), 10, fan=8).collect()
    assert sorted((r["rank"], r.chunk_id) for r in got) == [(i + 1, k) for i, (_, k) in enumerate(sorted((-s, k) for _, k, s, _ in rows)[:10])]


def test_index_finds_most(spark, sf):
    rows = Q.r6_recall(spark, sf).collect()
    assert sum(r.hits for r in rows) >= 0.95 * sum(r.wanted for r in rows) and all(r.wanted == 20 for r in rows)


def test_index_holds_every_row(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(k, (centres[k % 6] + rng.normal(size=8)).tolist()) for k in range(600)] + [(600, [0.0] * 8), (601, None), (None, [1.0] * 8)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = S.build_index(chunks, lists=6, sample_rows=100, file_rows=50)
    held = spark.read.parquet(index.path)
    assert held.count() == 1201 and held.filter("first = list").count() == held.select("chunk_id").distinct().count() == 601 and len(index.centroids) == 6
    queries = chunks.filter("chunk_id % 100 = 0").select(F.col("chunk_id").cast("string").alias("query"), F.col("embedding").alias("vector"))
    exact = {(r.query, r.chunk_id, r["rank"]) for r in S.dense_many(chunks, queries, 20).collect()}
    assert {(r.query, r.chunk_id, r["rank"]) for r in S.search_index(spark, index, queries, 20, probes=6).collect()} == exact
    one = S.index_recall(S.search_index(spark, index, queries.filter("query <> '600'"), 20, probes=1), S.dense_many(chunks, queries.filter("query <> '600'"), 20)).collect()
    assert sum(r.hits for r in one) >= 0.95 * sum(r.wanted for r in one)  # clusters: one list of six is enough
    with pytest.raises(ValueError):
        S.build_index(chunks.filter("false"))

"""Dense, lexical and fused retrieval, duplicate removal, diversity, and context under a budget."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlake.functions.embed import cosine, lexical_score, reciprocal_rank
from ledgerlake.functions.text import shingles
from ledgerlake.operators.filters import retrieval_filters
from ledgerlake.plans.requests import Budget, RetrievalRequest


def top_k(scored: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The best k by score, then by key as text, with ranks from 1: a top-k, not a sort of everything."""
    best = scored.orderBy(F.desc(score), F.col(key).cast("string")).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), F.col(key).cast("string"))))  # k rows


def dense(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine to the query vector; a chunk without a vector has none."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return top_k(chunks.filter(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), wanted).alias("score")), "score", key, k)


def lexical(chunks: DataFrame, query: str, k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Share of a text's words that are query terms; only texts that hold one."""
    terms = re.findall("[a-z0-9]+", query.lower())
    return top_k(chunks.select(key, lexical_score(F.col(text), terms).alias("score")).filter("score > 0"), "score", key, k)


def fused(dense_ranks: DataFrame, lexical_ranks: DataFrame, key: str = "chunk_id", k: int = 60) -> DataFrame:
    """Both candidate lists by reciprocal ranks."""
    a = dense_ranks.select(key, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    b = lexical_ranks.select(key, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    return a.join(b, key, "full_outer").withColumn("score", reciprocal_rank(F.col("dense_rank"), k) + reciprocal_rank(F.col("lexical_rank"), k))


def _select(pdf: pd.DataFrame, request: RetrievalRequest) -> pd.DataFrame:
    """Greedy over ranked candidates (500 at most): drop copies, then cap documents and periods among those taken.

    What a cap turns away comes after what is taken, in rank order.
    """
    kept: list[tuple[str, set]] = []
    taken, later = [], []
    documents, periods = Counter(), Counter()
    for row in pdf.sort_values(["score", "ckey"], ascending=[False, True]).itertuples(index=False):
        mine = set(row.sh)
        copy = any(row.h == h or (not mine and not s) or (mine and s and len(mine & s) / len(mine | s) >= request.near_duplicate) for h, s in kept)
        if copy:
            continue
        kept.append((row.h, mine))
        if documents[row.document_id] < request.per_document and (row.period is None or periods[row.period] < request.per_period):
            documents[row.document_id] += 1
            periods[row.period] += row.period is not None
            taken.append(row)
        else:
            later.append(row)
    out = pd.DataFrame([*taken, *later], columns=pdf.columns)[["ckey", "score"]].head(request.top_k)
    out["final_rank"] = range(1, len(out) + 1)
    return out


def retrieve(chunks: DataFrame, request: RetrievalRequest, query_vector: list[float] | None = None, rerank=None) -> DataFrame:
    """The request's chunks in their final order.

    chunks: chunk_id, document_id, text, embedding, period, and the columns that filters name. Only the candidates'
    texts (1,000 rows at most) reach the greedy step.
    """
    pool = retrieval_filters(chunks, request.filters)
    found = []
    if request.mode in ("dense", "hybrid") and query_vector is not None:
        found.append(dense(pool, query_vector, request.candidates))
    if request.mode in ("lexical", "hybrid"):
        found.append(lexical(pool, request.query, request.candidates))
    if not found:
        raise ValueError("dense retrieval needs a query vector")
    ranked = fused(*found).select("chunk_id", "score") if len(found) == 2 else found[0].select("chunk_id", "score")
    if rerank is not None:
        ranked = rerank(ranked)
    body = pool.join(F.broadcast(ranked), "chunk_id")  # 1,000 rows at most
    words = F.coalesce("text", F.lit(""))
    slim = body.select(F.lit(1).alias("_g"), F.col("chunk_id").cast("string").alias("ckey"), "score", "document_id", F.col("period").cast("string").alias("period"), shingles(words).alias("sh"), F.sha2(words.cast("binary"), 256).alias("h"))
    chosen = slim.groupBy("_g").applyInPandas(lambda pdf: _select(pdf.drop(columns="_g"), request), "ckey string, score double, final_rank long")
    return chosen.select(F.col("ckey").alias("chunk_id"), "score", "final_rank")


# What each strategy reads, in order, and the action it is traced by.
READS = {"none": (), "summary_only": ("documents",), "section_level": ("sections",), "structured_only": ("facts",), "hybrid": ("documents", "sections", "facts", "chunks"), "detailed": ("documents", "sections", "chunks")}
ACTIONS = {
    "none": "abstain_before_search", "summary_only": "document_summary_lookup", "section_level": "expand_to_section_summaries", "structured_only": "structured_financial_fact_lookup",
    "hybrid": "combine_structured_and_text_evidence", "detailed": "detailed_chunk_search",
}


def strategy_evidence(strategy: str, attempt: int, most_chunks: int, sources: dict[str, Callable[[], DataFrame]], search: Callable[[str, int], DataFrame]) -> tuple[DataFrame | None, str]:
    """(evidence of a strategy's sources in one frame, action). `search` takes a mode and how many chunks to find.

    Each attempt asks for more chunks; a detailed one after the first searches by words alone. Columns that a source lacks are null.
    """
    again = strategy == "detailed" and attempt > 1
    parts = [search("lexical" if again else "hybrid", min(most_chunks, 8 + 4 * attempt)) if name == "chunks" else sources[name]() for name in READS[strategy]]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, "lexical_fallback" if again else ACTIONS[strategy]


def compared_modes(chunks: DataFrame, queries: list[tuple[str, str, list[float]]], expected: DataFrame, key: str = "key", top_k: int = 10) -> DataFrame:
    """Recall, precision and share of copies of dense, lexical and hybrid retrieval over some queries (name, text, vector).

    `chunks` also has the key that expected (query, key) names; results of all modes and queries are one frame.
    """
    found = None
    names = chunks.select(F.col("chunk_id").cast("string").alias("_id"), F.col(key).alias("key"))
    for mode in ("dense", "lexical", "hybrid"):
        for name, text, vector in queries:
            got = retrieve(chunks, RetrievalRequest(text, mode=mode, top_k=top_k), vector).select("chunk_id").join(names, F.col("chunk_id") == F.col("_id"))
            part = got.select(F.lit(mode).alias("mode"), F.lit(name).alias("query"), "key")
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no queries")
    place = F.row_number().over(W.partitionBy("mode", "query", "key").orderBy(F.lit(1)))
    return retrieval_quality(found.withColumn("copy", place > 1), expected)


# The order in which kinds of evidence fill a context.
PRIORITY = {"document_summary": 0, "section_summary": 1, "financial_fact": 2, "chunk": 3}


def assemble(evidence: list[dict], budget: Budget) -> list[dict]:
    """Evidence taken one by one: best kind first, then the company and period that have least so far, then the label.

    Whatever would break a cap is passed over; the piece that overruns the tokens is cut to what is left.
    """
    period = lambda e: f"{e['fiscal_year']}:{e['fiscal_period']}" if e.get("fiscal_year") and e.get("fiscal_period") else e.get("fiscal_year") and str(e["fiscal_year"])
    left, out = list(evidence), []
    companies, periods, documents, sections = Counter(), Counter(), set(), set()
    chunks = tokens = 0
    while left and tokens < budget.tokens:
        e = min(left, key=lambda e: (PRIORITY[e["kind"]], companies[e.get("company_id")], periods[period(e)], e["label"]))
        left.remove(e)
        full = companies[e.get("company_id")] >= budget.per_company or periods[period(e)] >= budget.per_period
        full |= bool(e.get("document_id")) and e["document_id"] not in documents and len(documents) >= budget.documents
        full |= bool(e.get("section_id")) and e["section_id"] not in sections and len(sections) >= budget.sections
        full |= e["kind"] == "chunk" and chunks >= budget.chunks
        if full:
            continue
        room = budget.tokens - tokens
        if e["tokens"] > room:
            head = e["content"][: 4 * room]
            e = e | {"content": head.rsplit(" ", 1)[0].strip() or head, "tokens": room}
        out.append(e)
        tokens += e["tokens"]
        companies[e.get("company_id")] += 1
        periods[period(e)] += 1
        documents |= {e["document_id"]} if e.get("document_id") else set()
        sections |= {e["section_id"]} if e.get("section_id") else set()
        chunks += e["kind"] == "chunk"
    return out


def retrieval_quality(returned: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean recall, precision and share of copies for each mode; recall 1 if nothing is expected, precision 0 if nothing returned.

    returned: mode, query, key, copy; expected: query, key.
    """
    hits = returned.join(expected.withColumn("hit", F.lit(1)), ["query", "key"], "left").groupBy("mode", "query").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.count_if("copy").alias("copies"))
    want = expected.groupBy("query").agg(F.count_distinct("key").alias("wanted"))
    each = returned.select("mode").distinct().crossJoin(want).join(hits, ["mode", "query"], "left").fillna(0)  # modes are few
    recall = F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("hits") / F.greatest("wanted", F.lit(1)))
    precision = F.when(F.col("n") == 0, 0.0).otherwise(F.col("hits") / F.greatest("n", F.lit(1)))
    copies = F.when(F.col("n") == 0, 0.0).otherwise(F.col("copies") / F.greatest("n", F.lit(1)))
    return each.groupBy("mode").agg(F.avg(recall).alias("recall"), F.avg(precision).alias("precision"), F.avg(copies).alias("duplicate_rate"))

"""Retrieval for a table of queries: one pass over the chunks for each way of ranking, and an inverted file of vectors.

Queries go to the tasks in blocks of a stated number; a task scores its chunks against all of a block, keeps the best
few of each query, and these merge by tree: first among groups of tasks, then over all. Scores are rounded to nine
places, so that equal chunks tie wherever they lie; ties go to the smaller key, as text.

A null vector has no score; null components count as 0, a vector without length has cosine 0, and of two lengths the
longer one's tail counts for its own length alone. A text without words has no score. A null key or query takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerlake.functions.embed import reciprocal_rank
from ledgerlake.functions.text import fingerprint_words, shingles
from ledgerlake.operators.retrieval import _select, retrieval_quality
from ledgerlake.plans.requests import RetrievalRequest
from ledgerlake.session import shared_folder, stored

FOUND = "query string, chunk_id string, score double, part int"
DIGITS = 9


class Leaders:
    """The best k (score, key) of each query so far."""

    def __init__(self, queries: int, k: int, least: float = -np.inf):
        self.scores = np.full((queries, k), -np.inf)
        self.keys = np.full((queries, k), "", dtype=object)
        self.least = least

    def offer(self, scores: np.ndarray, keys: np.ndarray, rows: np.ndarray | None = None) -> None:
        """scores: a row for each query (of `rows`, or all), a column for each key."""
        rows = np.arange(len(self.scores)) if rows is None else rows
        k = self.scores.shape[1]
        hit = (scores >= self.scores[rows, -1, None]) & (scores > self.least)
        many = np.flatnonzero(hit.sum(1) > 4 * k)
        if len(many):
            own = np.where(hit[many], scores[many], -np.inf)
            hit[many] &= own >= np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        some = np.unique(i)
        query = np.concatenate([i, np.repeat(some, k)])
        score = np.concatenate([scores[i, j], self.scores[rows[some]].ravel()])
        key = np.concatenate([keys[j], self.keys[rows[some]].ravel()])
        order = np.lexsort((key.astype(str), -score, query))
        begins = np.searchsorted(query[order], some)
        best = order[begins[:, None] + np.arange(k)]
        self.scores[rows[some]], self.keys[rows[some]] = score[best], key[best]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        from pyspark import TaskContext

        i, j = np.nonzero(self.scores > -np.inf)
        columns = [pa.array([names[x] for x in i.tolist()], pa.string()), pa.array(self.keys[i, j].tolist(), pa.string()), pa.array(self.scores[i, j]), pa.array([TaskContext.get().partitionId()] * len(i), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "chunk_id", "score", "part"])


def merged(found: DataFrame, k: int, fan: int = 64) -> DataFrame:
    """(query, chunk_id, score, rank): the best k of each query, by tree, so no task sees more than fan * k rows of one query or k of each group."""
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy("query", *by).orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)
    groups = best(found.withColumn("part", F.floor(F.col("part") / fan)), "part")
    return best(groups.drop("part", "rank")).select("query", "chunk_id", "score", "rank")


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length of vector in a list column; null components are 0."""
    lengths = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    values = np.nan_to_num(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float))
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for size in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def cosines(queries: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Rounded cosines, a row a query."""
    size = min(queries.shape[1], chunks.shape[1])
    scale = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(chunks, axis=1))
    with np.errstate(all="ignore"):
        return np.round(np.where(scale > 0, queries[:, :size] @ chunks[:, :size].T / scale, 0.0), DIGITS) + 0.0


def query_blocks(queries: DataFrame, columns: list[str], most: int = 1024) -> Iterator[list]:
    """The queries' rows in blocks of about `most`, by hash, each collected when its turn comes."""
    own = stored(queries.filter("query is not null").select(F.col("query").cast("string").alias("query"), *columns).dropDuplicates(["query"]))
    blocks = max(1, ceil(own.count() / most))
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        if rows:
            yield rows


def _all(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)


def dense_many(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query, chunk_id, score, rank) by exact cosine; queries: query, vector."""
    pool = chunks.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    parts = []
    for rows in query_blocks(queries.filter("vector is not null"), ["vector"]):
        names = [r.query for r in rows]
        sent = chunks.sparkSession.sparkContext.broadcast(list(vectors_of(pa.array([r.vector for r in rows], pa.list_(pa.float64())))))

        def run(batches: Iterator[pa.RecordBatch], names=names, sent=sent) -> Iterator[pa.RecordBatch]:
            best = Leaders(len(names), k)
            for batch in batches:
                keys = np.array(batch.column(0).to_pylist(), dtype=object)
                for at, own in vectors_of(batch.column(1)):
                    for i in range(0, len(at), 4096):
                        for rows, wanted in sent.value:
                            best.offer(cosines(wanted, own[i : i + 4096]), keys[at[i : i + 4096]], rows)
            yield best.batch(names)

        parts.append(pool.mapInArrow(run, FOUND))
    return merged(_all(parts, chunks.sparkSession), k)


def lexical_many(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(query, chunk_id, score, rank) by the share of a text's words that are a query's terms, of texts that hold one; queries: query, text.

    Words are cut by Spark, and only occurrences of any query's terms reach the tasks' Python.
    """
    parts = []
    asked = queries.select("query", F.array_distinct(fingerprint_words("text")).alias("terms")).filter(F.size("terms") > 0)
    for rows in query_blocks(asked, ["terms"]):
        names, terms = [r.query for r in rows], sorted({t for r in rows for t in r.terms})
        place = {t: i for i, t in enumerate(terms)}
        wanted = np.zeros((len(terms), len(rows)))
        for i, r in enumerate(rows):
            wanted[[place[t] for t in r.terms], i] = 1
        sent = chunks.sparkSession.sparkContext.broadcast((place, wanted))
        words = chunks.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), fingerprint_words(text).alias("w")).filter(F.size("w") > 0)
        pool = words.select("key", F.size("w").alias("n"), F.filter("w", lambda t: t.isin(terms)).alias("hits")).filter(F.size("hits") > 0)  # noqa: B023

        def run(batches: Iterator[pa.RecordBatch], names=names, sent=sent) -> Iterator[pa.RecordBatch]:
            place, wanted = sent.value
            best = Leaders(len(names), k, least=0.0)
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    counts = np.zeros((part.num_rows, len(place)))
                    hits = part.column(2)
                    codes = np.array([place[t] for t in hits.flatten().to_pylist()], np.int64)
                    np.add.at(counts, (np.repeat(np.arange(part.num_rows), np.asarray(hits.value_lengths())), codes), 1)
                    scores = np.round((counts @ wanted) / np.asarray(part.column(1))[:, None], DIGITS)
                    best.offer(scores.T, np.array(part.column(0).to_pylist(), dtype=object))
            yield best.batch(names)

        parts.append(pool.mapInArrow(run, FOUND))
    return merged(_all(parts, chunks.sparkSession), k)


def fused_many(dense_ranks: DataFrame, lexical_ranks: DataFrame, k: int = 60) -> DataFrame:
    """(query, chunk_id, score) of the candidates of both rankings, by reciprocal ranks."""
    a, b = dense_ranks.select("query", "chunk_id", F.col("rank").alias("a")), lexical_ranks.select("query", "chunk_id", F.col("rank").alias("b"))
    return a.join(b, ["query", "chunk_id"], "full_outer").select("query", "chunk_id", (reciprocal_rank(F.col("a"), k) + reciprocal_rank(F.col("b"), k)).alias("score"))


def ranked_modes(chunks: DataFrame, queries: DataFrame, candidates: int = 50) -> DataFrame:
    """(mode, query, chunk_id, score) of the candidates of each query by cosine, by words, and by both; one pass over the chunks for each of the first two."""
    dense, lexical = stored(dense_many(chunks, queries, candidates)), stored(lexical_many(chunks, queries, candidates))
    found = {"dense": dense, "lexical": lexical, "hybrid": fused_many(dense, lexical)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(mode).alias("mode"), "query", "chunk_id", "score") for mode, df in found.items()])


def selected(chunks: DataFrame, candidates: DataFrame, request: RetrievalRequest) -> DataFrame:
    """(mode, query, chunk_id, score, final_rank): copies dropped and documents and periods capped among each query's candidates.

    A group is one query's candidates, a few hundred at most whatever the data.
    """
    bodies = chunks.select(F.col("chunk_id").cast("string").alias("ckey"), "document_id", F.col("period").cast("string").alias("period"), F.coalesce("text", F.lit("")).alias("text"))
    own = candidates.withColumnRenamed("chunk_id", "_c").join(bodies, F.col("_c") == F.col("ckey"))
    slim = own.select("mode", "query", "ckey", "score", "document_id", "period", shingles("text").alias("sh"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _select(pdf.drop(columns=["mode", "query"]), request)
        return pd.DataFrame({"mode": key[0], "query": key[1], "chunk_id": out["ckey"], "score": out["score"], "final_rank": out["final_rank"]})

    return slim.groupBy("mode", "query").applyInPandas(run, "mode string, query string, chunk_id string, score double, final_rank long")


def retrieve_many(chunks: DataFrame, queries: DataFrame, request: RetrievalRequest) -> DataFrame:
    """(mode, query, chunk_id, score, final_rank) of every query in all three modes, as `retrieve` ranks one of them."""
    return selected(chunks, stored(ranked_modes(chunks, queries, request.candidates)), request)


def compared(returned: DataFrame, names: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean recall, precision and share of copies by mode. returned: mode, query, chunk_id; names: chunk_id, key; expected: query, key."""
    keyed = returned.join(names.select(F.col("chunk_id").cast("string").alias("_id"), "key"), F.col("chunk_id") == F.col("_id"))
    place = F.row_number().over(W.partitionBy("mode", "query", "key").orderBy("chunk_id"))
    return retrieval_quality(keyed.select("mode", "query", "key", (place > 1).alias("copy")), expected)


@dataclass(frozen=True)
class VectorIndex:
    """An inverted file: rows below `path` by list (0 for vectors without length, which any search reads), and the lists' centroids.

    A row lies in the few lists nearest to it; `first` is the nearest, and a query that probes it takes the row there alone.
    """

    path: str
    centroids: np.ndarray


def fitted(sample: np.ndarray, lists: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; an empty list takes the vector that fits its centroid worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        score = sample @ centroids.T
        own = score.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(score.max(1))[: len(empty)]]
        scale = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(scale > 0, sums / np.where(scale > 0, scale, 1), centroids)
    return centroids


def build_index(chunks: DataFrame, lists: int | None = None, sample_rows: int = 50_000, rounds: int = 10, key: str = "chunk_id", vector: str = "embedding", file_rows: int = 200_000, copies: int = 2) -> VectorIndex:
    """Every chunk with a vector, written by list. Centroids are fitted on about `sample_rows` rows drawn by the hash of their key; all rows are indexed.

    Each is written to its `copies` nearest lists. Vectors must share one length. Large lists are cut into files of about `file_rows`, so no task writes a list alone.
    """
    spark = chunks.sparkSession
    pool = chunks.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("chunk_id"), F.col(vector).cast("array<double>").alias("embedding"))
    total = pool.count()
    share = min(1.0, sample_rows / max(1, total))
    drawn = pool.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1)).limit(2 * sample_rows).select("embedding").toArrow()
    units = [x / np.linalg.norm(x) for _, m in vectors_of(drawn.column(0).combine_chunks()) for x in m if np.linalg.norm(x) > 0]
    if not units:
        raise ValueError("an index needs vectors with a length")
    centroids = fitted(np.array(units), lists or max(1, round(total**0.5 / 2)), rounds)
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros((batch.num_rows, min(copies, len(sent.value))), np.int32)
            for at, m in vectors_of(batch.column(1)):
                if m.shape[1] != sent.value.shape[1]:
                    raise ValueError(f"a vector has {m.shape[1]} components in an index of {sent.value.shape[1]}")
                order = np.argsort(-(m @ sent.value.T), axis=1, kind="stable")[:, : near.shape[1]] + 1
                near[at] = np.where((m != 0).any(1)[:, None], order, 0)
            for c in range(near.shape[1]):
                some = np.flatnonzero((near[:, c] > 0) | (c == 0))
                rows = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near[some, 0]), pa.array(near[some, c])], names=["chunk_id", "embedding", "first", "list"])

    placed = pool.mapInArrow(run, "chunk_id string, embedding array<double>, first int, list int")
    path = f"{shared_folder(spark)}/index"
    # about as many files as the rows ask for, and a large list in several
    files = max(1, ceil(total / file_rows))
    placed.repartition(max(files, 1), "list", F.pmod(F.xxhash64("chunk_id"), F.lit(files))).write.partitionBy("list").parquet(path)
    return VectorIndex(path, centroids)


def search_index(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query, chunk_id, score, rank): the best k by exact cosine among the `probes` lists nearest to each query; with all lists probed, among all rows.

    Only probed lists are read, and a task compares a list's rows with the queries that probe it.
    """
    rows_of = spark.read.schema("chunk_id string, embedding array<double>, first int, list int").parquet(index.path)
    parts = []
    for rows in query_blocks(queries.filter("vector is not null"), ["vector"]):
        names, wanted = [r.query for r in rows], np.nan_to_num(np.array([r.vector for r in rows], float))
        order = np.argsort(-(wanted @ index.centroids.T), axis=1, kind="stable")[:, :probes] + 1
        probing: dict[int, np.ndarray] = {0: np.arange(len(rows))} | {int(x): np.flatnonzero((order == x).any(1)) for x in np.unique(order)}
        probes_it = np.zeros((len(rows), len(index.centroids) + 1), bool)
        np.put_along_axis(probes_it, order, True, axis=1)
        sent = spark.sparkContext.broadcast((wanted, probing, probes_it))

        def run(batches: Iterator[pa.RecordBatch], names=names, sent=sent) -> Iterator[pa.RecordBatch]:
            wanted, probing, probes_it = sent.value
            best = Leaders(len(names), k)
            for batch in batches:
                keys, first, lists = np.array(batch.column(0).to_pylist(), dtype=object), *(np.asarray(batch.column(c)) for c in (2, 3))
                for at, own in vectors_of(batch.column(1)):
                    for x in np.unique(lists[at]).tolist():
                        some = np.flatnonzero(lists[at] == x)
                        for i in range(0, len(some), 4096):
                            part = some[i : i + 4096]
                            seen = probes_it[probing[x]][:, first[at[part]]] & (first[at[part]] != x)
                            best.offer(np.where(seen, -np.inf, cosines(wanted[probing[x]], own[part])), keys[at[part]], probing[x])
            yield best.batch(names)

        parts.append(rows_of.filter(F.col("list").isin(list(probing))).select("chunk_id", "embedding", "first", "list").mapInArrow(run, FOUND))
    return merged(_all(parts, spark), k)


def index_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, wanted, hits): how many of the exact results an index found."""
    hits = found.select("query", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(hits, ["query", "chunk_id"], "left").groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))

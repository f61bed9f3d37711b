"""The embedding index: which chunks to embed, what became of them, and whether an index fits a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ledgerlake.functions.embed import hashed_embedding
from ledgerlake.functions.text import rough_tokens

LONGEST_INPUT = 8192


def check_index(index: dict, model: str, dims: int) -> None:
    """Refuses to mix vectors of different models or sizes in an index."""
    if index["model"] != model or index["dims"] != dims:
        raise ValueError(f"index {index['name']} holds {index['model']} with {index['dims']} dimensions, not {model} with {dims}")


def chunk_states(chunks: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """The chunks with `state`: new, stale (another text was embedded, or forced), or fresh.

    `chunks` has chunk_id, content_hash; `index` has chunk_id, content_hash.
    """
    have = index.groupBy(F.col("chunk_id").alias("_id")).agg(F.max("content_hash").alias("_hash"))
    held = F.col("_id").isNotNull()
    stale = held & (F.lit(force) | ~F.col("_hash").eqNullSafe(F.col("content_hash")))
    return chunks.join(have, F.col("chunk_id") == F.col("_id"), "left").withColumn("state", F.when(~held, "new").when(stale, "stale").otherwise("fresh")).drop("_id", "_hash")


def embedded(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, dims: int = 384) -> DataFrame:
    """(chunk_id, content_hash, embedding, error): blank and overlong texts fail alone, the rest go on.

    `embed` takes (chunk_id, text) and returns (chunk_id, embedding); without it hashed words are used.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    error = F.when(blank, "blank text").when(rough_tokens("text") > LONGEST_INPUT, "text too long")
    checked = chunks.withColumn("error", error)
    good = checked.filter("error is null").select("chunk_id", "text")
    vectors = embed(good) if embed else hashed_embedding(good, "chunk_id", "text", dims)
    vectors = vectors.select(F.col("chunk_id").alias("_id"), "embedding")
    out = checked.join(vectors, F.col("chunk_id") == F.col("_id"), "left")
    lost = F.when(F.col("embedding").isNull(), "no vector returned").when(F.size("embedding") != dims, "wrong dimensions")
    return out.withColumn("error", F.coalesce("error", lost)).select("chunk_id", "content_hash", F.when(F.col("error").isNull(), F.col("embedding")).alias("embedding"), "error")


def index_counts(states: DataFrame, results: DataFrame) -> DataFrame:
    """One row: indexed, skipped, stale_rebuilt, failed."""
    failed = results.select(F.col("chunk_id").alias("_id"), F.col("error").isNotNull().alias("_failed"))
    rows = states.join(failed, F.col("chunk_id") == F.col("_id"), "left")
    good = F.coalesce(~F.col("_failed"), F.lit(False))
    return rows.agg(F.count_if(good).alias("indexed"), F.count_if(F.col("state") == "fresh").alias("skipped"), F.count_if(good & (F.col("state") == "stale")).alias("stale_rebuilt"), F.count_if(F.coalesce("_failed", F.lit(False))).alias("failed"))


def index_chunks(chunks: DataFrame, index: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, dims: int = 384, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the index after the run, counts): fresh chunks are skipped; a failed chunk keeps what the index had."""
    states = chunk_states(chunks, index, force)
    results = embedded(states.filter("state <> 'fresh'"), embed, dims)
    good = results.filter("error is null").select("chunk_id", "content_hash", "embedding")
    kept = index.select("chunk_id", "content_hash", "embedding").join(good.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(good), index_counts(states, results)

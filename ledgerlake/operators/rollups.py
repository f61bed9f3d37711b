"""Totals over corpora, runs and operations, each by one partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.functions.text import rate


def corpus_stats(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: rows of each table, tokens, distinct chunks embedded and their share (0 for no chunks).

    chunks: chunk_id, document_id, token_count; embeddings: chunk_id. Each side is one row before they meet.
    """
    d = documents.agg(F.count(F.lit(1)).alias("documents"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    e = embeddings.agg(F.count(F.lit(1)).alias("embeddings"), F.count_distinct("chunk_id").alias("embedded"))
    whole = d.crossJoin(c).crossJoin(e)
    return whole.withColumn("embedded_rate", rate(F.col("embedded"), F.col("chunks")))


def processing_rollup(results: DataFrame, keys: list[str]) -> DataFrame:
    """Versions by status, chunks kept and removed, and the share removed; results: status, candidates, kept."""
    n = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("versions"), F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"),
    )
    return n.withColumn("removed_rate", rate(F.col("candidates") - F.col("kept"), F.col("candidates")))


def calculation_evidence(points: DataFrame) -> DataFrame:
    """One row a branch_id: company and metric where all points share one, the time they span, the value of a single point."""
    only = lambda c: F.when(F.count_distinct(c) == 1, F.min(c)).alias(c)
    return points.groupBy("branch_id").agg(only("company"), only("metric"), F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.when(F.count(F.lit(1)) == 1, F.min("value")).alias("value"), F.count(F.lit(1)).alias("n_points"))


def newest_runs(runs: DataFrame, key: str, created: str, count: int) -> DataFrame:
    """The `count` newest runs, oldest of them first, each with how many there are in all."""
    total = runs.agg(F.count(F.lit(1)).alias("total"))
    return runs.orderBy(F.desc(created), F.desc(key)).limit(count).crossJoin(total).orderBy(created, key)


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens and cost of models; null sums where nothing was told."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 10).alias("cost"))


def telemetry(operations: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """Count, total time and a histogram row (operation, status, upper bound or null) of durations."""
    edge = F.coalesce(*[F.when(F.col("duration") <= b, F.lit(float(b))) for b in sorted(bounds)])
    return operations.groupBy("operation", "status", edge.alias("upper_bound")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"))


def available_units(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.array_sort(F.collect_set("unit")).alias("units"))

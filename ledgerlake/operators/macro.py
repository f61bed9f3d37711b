"""Macro series: typed queries, vintages, and upserts by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlake.functions.text import joined_hash
from ledgerlake.operators.filters import macro_filters
from ledgerlake.plans.requests import MacroRequest

VINTAGE = ("series_id", "observed_at", "realtime_start", "realtime_end")


def query_macro(observations: DataFrame, request: MacroRequest) -> DataFrame:
    """The first `limit` rows by series and date; without a range the newest of each series come first in that order."""
    rows = macro_filters(observations, request)
    if request.latest_vintage:
        rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy("series_id", "observed_at").orderBy(F.desc("realtime_start")))).filter("_rn = 1").drop("_rn")
    ranged = request.observed_from is not None or request.observed_to is not None
    return rows.orderBy(F.asc("series_id"), F.asc("observed_at") if ranged else F.desc("observed_at")).limit(request.limit)


def missing_series(observations: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(observations, "series_id", "left_anti")


def observation_hash() -> F.Column:
    return joined_hash("series_id", "observed_at", "realtime_start", "realtime_end", "value", "unit")


def upsert(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = VINTAGE, digest: str = "source_hash") -> DataFrame:
    """Stored rows with the batch laid over them, each with its action: inserted, updated, noop or kept."""
    keys = list(keys)
    rest = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*rest).alias("_old"))
    new = batch.dropDuplicates(keys).select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, keys, "full_outer")
    action = (
        F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted")
        .when(F.col(f"_old.{digest}").eqNullSafe(F.col(f"_new.{digest}")), "noop").otherwise("updated")
    )
    row = F.when(action.isin("kept", "noop"), F.col("_old")).otherwise(F.col("_new"))
    return both.select(*keys, row.alias("_row"), action.alias("action")).select(*keys, "_row.*", "action")


def latest_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert of whole rows: the last of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def stale_series(cached: DataFrame, series: DataFrame) -> DataFrame:
    """Series whose newest cached date lies before their last observation."""
    newest = cached.groupBy("series_id").agg(F.max("observed_at").alias("newest"))
    return series.join(newest, "series_id").filter("newest < observation_end").select("series_id", "newest", "observation_end")


def run_counters(results: DataFrame) -> DataFrame:
    return results.groupBy("series_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"), F.count_if(F.col("value").isNull()).alias("missing"))

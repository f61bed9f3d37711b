"""Typed queries over company facts: order and limit, restatement flags, latest filings, idempotent stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlake.operators.filters import fact_filters
from ledgerlake.plans.requests import FactRequest

OBSERVATION = ("company_id", "metric", "period_start", "period_end", "period_type", "unit", "fiscal_period")


def classify_period(start: Column, end: Column, fiscal_period: Column) -> Column:
    """instant, annual (300 days and more), quarter (70 to 110), year_to_date (Q2 to Q4, under 300), other."""
    days = F.datediff(end, start) + 1
    return (
        F.when(start.isNull(), "instant").when(days >= 300, "annual").when(days.between(70, 110), "quarter")
        .when(fiscal_period.isin("Q2", "Q3", "Q4") & (days < 300), "year_to_date").otherwise("other")
    )


def with_conflicts(facts: DataFrame, keys: tuple[str, ...] = OBSERVATION, value: str = "value") -> DataFrame:
    """Flags every row of an observation that has more than one value; nulls in keys are equal."""
    own = W.partitionBy(*keys)
    return facts.withColumn("has_conflict", F.min(value).over(own) != F.max(value).over(own))


def latest_filings(facts: DataFrame, keys: tuple[str, ...] = OBSERVATION) -> DataFrame:
    """One row an observation: the last filed, then the larger accession, then the larger id; by one aggregation."""
    newest = F.struct(F.coalesce("filed_date", F.lit("0001-01-01").cast("date")).alias("f"), F.coalesce("accession_number", F.lit("")).alias("a"), F.col("fact_id").alias("i"))
    others = [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(F.max_by(F.struct(*others), newest).alias("_best"))
    return best.select(*[k for k in keys], "_best.*").select(*facts.columns)


def annual_latest(facts: DataFrame) -> DataFrame:
    """One annual row for each company, metric, unit and period end."""
    return latest_filings(facts.filter("period_type = 'annual'"), ("company_id", "metric", "unit", "period_end"))


def primary_tickers(tickers: DataFrame) -> DataFrame:
    """The smallest current primary symbol of each company."""
    return tickers.filter("is_primary and valid_to is null").groupBy("company_id").agg(F.min("symbol").alias("ticker"))


def query_facts(facts: DataFrame, companies: DataFrame, tickers: DataFrame, request: FactRequest) -> DataFrame:
    """The request's rows: newest first within company and metric, limited over all, then flagged for conflicts.

    Conflicts are looked for among the limited rows. The tickers join and the flag see at most `limit` rows.
    """
    named = fact_filters(facts, request, tickers).join(companies.select("company_id", "company_name"), "company_id")
    newest = [F.asc("company_name"), F.asc("metric"), F.desc("period_end"), F.desc_nulls_last("filed_date"), F.desc_nulls_last("accession_number"), F.desc("fact_id")]
    cut = named.orderBy(*newest).limit(request.limit)
    return with_conflicts(cut).join(primary_tickers(tickers), "company_id", "left")


def warnings(result: DataFrame) -> DataFrame:
    """The query's warnings as rows."""
    told = result.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("has_conflict").cast("int")), F.lit(0)).alias("c"))
    both = F.array(F.when(F.col("n") == 0, F.lit("no_matching_financial_facts")), F.when(F.col("c") == 1, F.lit("conflicting_or_restated_values_present")))
    return told.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("warning"))


def source_hash(row: dict[str, Column]) -> Column:
    """sha256 of the row as JSON with sorted keys, as json.dumps writes it: spaces after , and :, null for nulls."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(quote(v.cast("string")), F.lit("null"))) for k, v in sorted(row.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).cast("binary"), 256)


def insert_new(stored: DataFrame, batch: DataFrame, key: str = "source_hash") -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): rows whose key is neither stored nor earlier in the batch."""
    fresh = batch.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    total = batch.agg(F.count(F.lit(1)).alias("seen")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("inserted")))
    return fresh, total.select("inserted", (F.col("seen") - F.col("inserted")).alias("duplicates"))


def readiness(facts: DataFrame, wanted: DataFrame, growth: tuple[str, ...] = ("growth", "change")) -> DataFrame:
    """For each wanted (company_id, metric, operation): available, partial or missing, by how many facts there are."""
    held = facts.groupBy("company_id", "metric").agg(F.count(F.lit(1)).alias("n"))
    need = F.when(F.col("operation").isin(*growth), 2).otherwise(1)
    n = F.coalesce("n", F.lit(0))
    return wanted.join(held, ["company_id", "metric"], "left").select("company_id", "metric", "operation", n.alias("n_facts"), F.when(n >= need, "available").when(n > 0, "partial").otherwise("missing").alias("status"))


def ready_companies(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Companies that have an indexed chunk and a fact."""
    return chunks.select("company_id").distinct().join(facts, "company_id", "left_semi")

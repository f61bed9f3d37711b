"""Requests as predicates. An empty choice filters nothing; a null never passes a set filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.plans.requests import FactRequest, MacroRequest, RetrievalFilters

# column of each set filter of retrieval, and of the ranges
_SETS = {"company_ids": "company_id", "document_version_ids": "document_version_id", "accession_numbers": "accession_number", "document_kinds": "kind", "filing_forms": "filing_form", "fiscal_years": "fiscal_year", "fiscal_periods": "fiscal_period", "section_codes": "section_code", "source_systems": "source_system"}
_RANGES = {"filing_date": ("filing_date_from", "filing_date_to"), "period_end": ("period_end_from", "period_end_to")}


def within(df: DataFrame, column: str, first, last) -> DataFrame:
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(first))
    if last is not None:
        df = df.filter(F.col(column) <= F.lit(last))
    return df


def one_of(df: DataFrame, column: str, values: tuple) -> DataFrame:
    return df.filter(F.col(column).isin(list(values))) if values else df


def retrieval_filters(df: DataFrame, filters: RetrievalFilters) -> DataFrame:
    for name, column in _SETS.items():
        df = one_of(df, column, getattr(filters, name))
    for column, (first, last) in _RANGES.items():
        df = within(df, column, getattr(filters, first), getattr(filters, last))
    return df


def fact_filters(facts: DataFrame, request: FactRequest, tickers: DataFrame | None = None) -> DataFrame:
    """Fact rows of the request; tickers are matched in upper case among the current ones, by a semi-join."""
    facts = one_of(facts, "company_id", request.company_ids)
    if request.tickers:
        wanted = tickers.filter(F.col("valid_to").isNull() & F.upper("symbol").isin([t.strip().upper() for t in request.tickers])).select("company_id")
        facts = facts.join(wanted, "company_id", "left_semi")
    for column, values in (("metric", request.metrics), ("fiscal_year", request.fiscal_years), ("fiscal_period", request.fiscal_periods), ("period_type", request.period_types), ("unit", request.units)):
        facts = one_of(facts, column, values)
    facts = within(facts, "period_end", request.period_from, request.period_to)
    return facts.filter(~F.col("is_amendment")) if request.exclude_amendments else facts


def macro_filters(observations: DataFrame, request: MacroRequest) -> DataFrame:
    wanted = list(dict.fromkeys(s.strip().upper() for s in request.series_ids))
    rows = within(observations.filter(F.col("series_id").isin(wanted)), "observed_at", request.observed_from, request.observed_to)
    return rows if request.include_missing else rows.filter(F.col("value").isNotNull())

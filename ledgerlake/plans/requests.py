"""Typed requests, checked on the driver before any plan is built."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import date


def _bounded(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


def _ordered(name: str, first, last) -> None:
    if first is not None and last is not None and first > last:
        raise ValueError(f"{name}: the range ends before it begins")


@dataclass(frozen=True)
class FactRequest:
    company_ids: tuple = ()
    tickers: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    period_from: date | None = None
    period_to: date | None = None
    fiscal_years: tuple[int, ...] = ()
    fiscal_periods: tuple[str, ...] = ()
    period_types: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    exclude_amendments: bool = False
    limit: int = 200

    def __post_init__(self):
        _bounded("limit", self.limit, 1, 2000)
        _ordered("period", self.period_from, self.period_to)


@dataclass(frozen=True)
class MacroRequest:
    series_ids: tuple[str, ...]
    observed_from: date | None = None
    observed_to: date | None = None
    include_missing: bool = False
    latest_vintage: bool = False
    limit: int = 1000

    def __post_init__(self):
        if not self.series_ids:
            raise ValueError("at least one series is needed")
        _bounded("limit", self.limit, 1, 100_000)
        _ordered("observed", self.observed_from, self.observed_to)


@dataclass(frozen=True)
class RetrievalFilters:
    company_ids: tuple = ()
    document_version_ids: tuple = ()
    accession_numbers: tuple[str, ...] = ()
    document_kinds: tuple[str, ...] = ()
    filing_forms: tuple[str, ...] = ()
    filing_date_from: date | None = None
    filing_date_to: date | None = None
    period_end_from: date | None = None
    period_end_to: date | None = None
    fiscal_years: tuple[int, ...] = ()
    fiscal_periods: tuple[str, ...] = ()
    section_codes: tuple[str, ...] = ()
    source_systems: tuple[str, ...] = ()

    def __post_init__(self):
        _ordered("filing date", self.filing_date_from, self.filing_date_to)
        _ordered("period end", self.period_end_from, self.period_end_to)

    def given(self) -> dict:
        """The filters that are set."""
        return {k: v for k, v in asdict(self).items() if v not in ((), None)}


@dataclass(frozen=True)
class RetrievalRequest:
    query: str
    mode: str = "hybrid"
    top_k: int = 10
    candidates: int = 50
    per_document: int = 3
    per_period: int = 4
    near_duplicate: float = 0.92
    filters: RetrievalFilters = field(default_factory=RetrievalFilters)

    def __post_init__(self):
        if not self.query.strip():
            raise ValueError("the query is empty")
        if self.mode not in ("dense", "lexical", "hybrid"):
            raise ValueError(f"unknown mode {self.mode}")
        _bounded("top_k", self.top_k, 1, 100)
        _bounded("candidates", self.candidates, 1, 500)
        _bounded("per_document", self.per_document, 1, 100)
        _bounded("per_period", self.per_period, 1, 100)
        if not 0 <= self.near_duplicate <= 1:
            raise ValueError("near_duplicate must be between 0 and 1")


@dataclass(frozen=True)
class Budget:
    """What assembled context may hold."""

    documents: int = 5
    sections: int = 10
    chunks: int = 12
    tokens: int = 4000
    per_company: int = 8
    per_period: int = 6


def fingerprint(request) -> str:
    """sha256 of a request's compact JSON with sorted keys: equal requests share cached results."""
    return hashlib.sha256(json.dumps(asdict(request), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()

"""Research plans on the driver: branches and their checks, routes, retrieval strategies, budgets and sufficiency.

A plan is a handful of branches; none of this touches rows. Branches run as DataFrames by operators elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date
from graphlib import CycleError, TopologicalSorter

from ledgerlake.plans.requests import Budget, RetrievalFilters

SOURCES = ("financial_facts", "macro_series", "document_retrieval")
NUMERIC = ("financial_facts", "macro_series")

# Words that decide a strategy, the order of strategies, and section names.
COMPARATIVE = ("compare", "comparison", "versus", " vs ", "difference", "trend", "порівняй", "порівнян", "проти", "динамік")
SUMMARY = ("summary", "overview", "high level", "коротко", "огляд", "підсум")
EXPLANATORY = ("why", "explain", "reason", "ризик", "чому", "поясни")
SMALL_TALK = r"(?i)(hello|hi|thanks|thank you|привіт|дякую)[.!? ]*"
# the detector of sections calls discussions mda, so filters do too
SECTIONS = {"risk_factors": ("risk", "risks", "ризик"), "business": ("business", "бізнес"), "mda": ("md&a", "management discussion", "керівництв")}
FALLBACKS = {
    "none": ("none",),
    "summary_only": ("summary_only", "section_level", "detailed"),
    "section_level": ("section_level", "detailed", "hybrid"),
    "detailed": ("detailed", "section_level", "hybrid"),
    "structured_only": ("structured_only", "hybrid", "detailed"),
    "hybrid": ("hybrid", "structured_only", "detailed"),
}
BUDGETS = {
    "none": Budget(documents=1, sections=1, chunks=1, tokens=100, per_company=1, per_period=1),
    "structured_only": Budget(documents=2, sections=2, chunks=4, tokens=800, per_company=4, per_period=2),
    "summary_only": Budget(documents=3, sections=5, chunks=2, tokens=1500, per_company=3, per_period=2),
}
COMPARATIVE_BUDGET = Budget(documents=8, sections=16, chunks=24, tokens=8000, per_company=12, per_period=8)


@dataclass(frozen=True)
class Branch:
    branch_id: str
    kind: str
    depends_on: tuple[str, ...] = ()
    required: bool = True
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    branches: tuple[Branch, ...]
    route: str = ""
    reasons: tuple[str, ...] = ()

    def order(self) -> list[str]:
        """The branches in an order in which each follows what it reads."""
        return list(TopologicalSorter({b.branch_id: b.depends_on for b in self.branches}).static_order())


def operation_of(branch: Branch) -> str:
    """A calculation's operation without the ending that some plans give growth."""
    return branch.options.get("operation", "").removesuffix("_growth")


def year_earlier(day: date) -> date:
    return day.replace(year=day.year - 1, day=28) if (day.month, day.day) == (2, 29) else day.replace(year=day.year - 1)


def route_of(plan: Plan) -> str:
    """What a plan's branches amount to."""
    kinds = {b.kind for b in plan.branches}
    if not kinds:
        return "unsupported"
    documents, numbers = "document_retrieval" in kinds, kinds & set(NUMERIC)
    if documents and numbers:
        return "mixed"
    if documents:
        return "document_retrieval"
    return "calculation" if kinds & {"calculation", "chart"} or len(numbers) > 1 else numbers.pop()


def plan_faults(plan: Plan, most_sources: int = 10, needed: tuple[str, ...] = (), known_companies: frozenset = frozenset()) -> list[str]:
    """Everything that is wrong with a plan; an empty list for a sound one."""
    out = []
    by_id = {b.branch_id: b for b in plan.branches}
    if len(by_id) < len(plan.branches):
        out.append("branch ids repeat")
    missing = sorted({d for b in plan.branches for d in b.depends_on} - set(by_id))
    if missing:
        out.append(f"unknown branches: {', '.join(missing)}")
    try:
        plan.order()
    except CycleError:
        out.append("branches depend on each other in a circle")
    if sum(b.kind == "chart" for b in plan.branches) > 1:
        out.append("more than one chart")
    sources = [b for b in plan.branches if b.kind in SOURCES]
    if len(sources) > most_sources:
        out.append("more sources than the budget allows")
    for b in plan.branches:
        read = [by_id[d] for d in b.depends_on if d in by_id]
        if b.kind in SOURCES and b.depends_on:
            out.append(f"{b.branch_id}: a source depends on nothing")
        if b.kind == "calculation" and (not read or any(r.kind not in NUMERIC for r in read)):
            out.append(f"{b.branch_id}: a calculation reads numeric sources")
        if b.kind == "calculation" and any(len(r.options.get(k, ())) > 1 for r in read for k in ("company_ids", "metrics", "series_ids")):
            out.append(f"{b.branch_id}: an input has several series")
        if b.kind == "chart" and any(r.kind not in (*NUMERIC, "calculation") for r in read):
            out.append(f"{b.branch_id}: a chart reads numeric branches")
        if b.kind == "financial_facts" and set(b.options.get("company_ids", ())) - known_companies:
            out.append(f"{b.branch_id}: a company was not resolved")
    if plan.route and plan.route != route_of(plan):
        out.append("the route doesn't fit the branches")
    lacking = sorted(set(needed) - {b.kind for b in plan.branches})
    if lacking:
        out.append(f"not covered: {', '.join(lacking)}")
    return out


def normalised(plan: Plan, companies: tuple = ()) -> Plan:
    """Fact branches without companies get the only one resolved; charts read all numeric results that nothing else reads."""
    out = []
    for b in plan.branches:
        if b.kind == "financial_facts" and len(companies) == 1 and not b.options.get("company_ids") and not b.options.get("tickers"):
            b = replace(b, options={**b.options, "company_ids": companies})
        if b.kind == "chart":
            read = {d for x in plan.branches if x.kind == "calculation" for d in x.depends_on}
            loose = [x.branch_id for x in plan.branches if x.kind == "calculation" or (x.kind in NUMERIC and x.branch_id not in read)]
            b = replace(b, depends_on=tuple(dict.fromkeys([*b.depends_on, *loose])))
        out.append(b)
    return replace(plan, branches=tuple(out))


def growth_template(companies: dict[str, str], metric: str, limit: int = 24) -> Plan:
    """Facts and growth of one metric for each company (id and name), and a chart of all."""
    branches = []
    for k, (company, name) in enumerate(companies.items()):
        branches.append(Branch(f"facts_{k}", "financial_facts", options={"company_ids": (company,), "metrics": (metric,), "limit": limit}))
        branches.append(Branch(f"growth_{k}", "calculation", (f"facts_{k}",), options={"operation": "year_over_year", "label": name}))
    chart = Branch("chart", "chart", tuple(b.branch_id for b in branches if b.kind == "calculation"), required=False, options={"chart_type": "line"})
    return Plan((*branches, chart))


def section_codes(query: str) -> tuple[str, ...]:
    said = query.casefold()
    return tuple(code for code, words in SECTIONS.items() if any(w in said for w in words))


@dataclass(frozen=True)
class Question:
    """What resolution found in a question."""

    text: str
    company_ids: tuple = ()
    fiscal_years: tuple[int, ...] = ()
    fiscal_periods: tuple[str, ...] = ()
    accession_numbers: tuple[str, ...] = ()
    filing_forms: tuple[str, ...] = ()
    dates: tuple = ()
    metrics: tuple[str, ...] = ()
    ambiguous: bool = False
    unresolved: bool = False


@dataclass(frozen=True)
class RetrievalPlan:
    question: Question
    strategy: str
    reason: str
    comparative: bool
    filters: RetrievalFilters
    budget: Budget
    attempts: tuple[str, ...]
    documents_only: bool = False


def plan_retrieval(question: Question, documents_only: bool = False, most_attempts: int = 3) -> RetrievalPlan:
    """The first rule that fits decides the strategy; filters, budget and fallbacks follow."""
    said = question.text.casefold()
    holds = lambda words: any(w in said for w in words)
    comparative = len(question.company_ids) > 1 or len(question.fiscal_years) > 1 or holds(COMPARATIVE)
    rules = (
        (question.ambiguous, "none", "ambiguous_entity_requires_clarification"),
        (question.unresolved, "none", "exact_identifier_not_found"),
        (bool(re.fullmatch(SMALL_TALK, question.text)), "none", "question_does_not_require_evidence"),
        (documents_only, "detailed", "document_evidence_required"),
        (bool(question.metrics) and holds(EXPLANATORY), "hybrid", "metric_requires_structured_and_narrative_evidence"),
        (bool(question.metrics), "structured_only", "known_metric_prefers_structured_facts"),
        (holds(SUMMARY), "summary_only", "high_level_intent_prefers_summaries"),
        (comparative, "detailed", "comparative_intent_requires_source_chunks"),
        (bool(section_codes(said)), "section_level", "known_section_intent"),
        (True, "detailed", "default_evidence_strategy"),
    )
    strategy, reason = next((s, why) for fits, s, why in rules if fits)
    budget = BUDGETS.get(strategy) or (COMPARATIVE_BUDGET if comparative else Budget())
    filters = RetrievalFilters(
        company_ids=question.company_ids, accession_numbers=question.accession_numbers, filing_forms=question.filing_forms, period_end_from=min(question.dates, default=None),
        period_end_to=max(question.dates, default=None), fiscal_years=question.fiscal_years, fiscal_periods=question.fiscal_periods, section_codes=section_codes(said),
    )
    return RetrievalPlan(question, strategy, reason, comparative, filters, budget, attempts(strategy, documents_only, most_attempts), documents_only)


def attempts(strategy: str, documents_only: bool = False, most: int = 3) -> tuple[str, ...]:
    """The strategies to try in turn; with documents only, those that read facts give way to those that read text."""
    if not documents_only or strategy == "none":
        return FALLBACKS[strategy][:most]
    textual = ("summary_only", "section_level", "detailed")
    first = strategy if strategy in textual else "detailed"
    rest = {"summary_only": ("section_level", "detailed"), "section_level": ("detailed", "summary_only"), "detailed": ("section_level", "summary_only")}
    return (first, *rest[first])[:most]


def missing_evidence(context: list[dict], plan: RetrievalPlan) -> list[str]:
    """What assembled context still lacks; nothing if it suffices."""
    if not context:
        return ["evidence"]
    out = []
    if plan.documents_only and not any(e["kind"] in ("document_summary", "section_summary", "chunk") for e in context):
        out.append("documents")
    if set(plan.filters.company_ids) - {e.get("company_id") for e in context}:
        out.append("companies")
    if plan.comparative and set(plan.filters.fiscal_years) - {e.get("fiscal_year") for e in context}:
        out.append("years")
    return out


def retrieve_adaptively(plan: RetrievalPlan, run: Callable[[str, int], list[dict]], assemble: Callable[[list[dict], Budget], list[dict]]) -> dict:
    """Try the strategies until the context suffices; `run` takes a strategy and how many chunks to ask for.

    Candidates of an attempt are at most its top_k and its context at most the budget, so both fit the driver.
    Returns the context, the trace of attempts, and whether to abstain.
    """
    trace, context = [], []
    for k, strategy in enumerate(plan.attempts):
        if strategy == "none":
            break
        context = assemble(run(strategy, min(plan.budget.chunks, 8 + 4 * k)), plan.budget)
        lacks = missing_evidence(context, plan)
        trace.append({"attempt": k + 1, "strategy": strategy, "evidence": len(context), "missing": lacks})
        if not lacks:
            return {"context": context, "trace": trace, "abstain": False}
    return {"context": context, "trace": trace, "abstain": True}


def outcome(plan: Plan, results: dict[str, int]) -> str:
    """complete, partial or insufficient: by how many rows each branch brought, required branches first."""
    empty = [b for b in plan.branches if not results.get(b.branch_id)]
    if any(b.required for b in empty):
        return "insufficient" if len(empty) == len(plan.branches) else "partial"
    return "partial" if empty else "complete"


def followed_up(before: Question, now: Question) -> Question:
    """A follow-up's question: what it doesn't name is taken from the question before."""
    kept = {name: getattr(now, name) or getattr(before, name) for name in ("company_ids", "fiscal_years", "fiscal_periods", "metrics", "filing_forms")}
    return replace(now, **kept)


def remembered(items: list[dict], new: dict, key: str, most: int) -> list[dict]:
    """The last `most` items with the new one at the end, in place of one with its key."""
    return [*[x for x in items if x[key] != new[key]], new][-most:]

"""Running research plans on the driver: default windows, fallbacks, cached results, retries and open circuits.

Runners build DataFrames; each branch's rows are computed once and written to the shared folder, within its attempts.
"""

from __future__ import annotations

import re
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import date
from itertools import count
from random import random
from threading import Lock

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame

from ledgerlake.plans.requests import FactRequest, fingerprint
from ledgerlake.plans.research import NUMERIC, SOURCES, Branch, Plan, operation_of, year_earlier
from ledgerlake.session import stored

DEFAULT_WINDOW = "default_chart_window"
PERIODS, DATES = ("period_from", "period_to", "fiscal_years", "fiscal_periods"), ("observed_from", "observed_to")
GROWTH = ("quarter_over_quarter", "year_over_year", "percentage_change")
ANNUAL_READY = ("year_over_year", "cagr", "absolute_change", "percentage_change")
QUARTERLY_LIMIT, MONTHLY_LIMIT = 24, 48


class Recoverable(Exception):
    """A source failed in a way that another attempt may mend."""


class CircuitOpen(Exception):
    """A source failed so often that it is left alone for a while."""


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    first: float = 0.5
    factor: float = 2.0
    longest: float = 30.0
    jitter: float = 0.2

    def pause(self, attempt: int, draw: float | None = None) -> float:
        """Seconds to wait after so many attempts: grown, bounded, and spread by the jitter to both sides."""
        grown = min(self.longest, self.first * self.factor ** max(0, attempt - 1))
        return max(0.0, grown * (1 + self.jitter * (2 * (random() if draw is None else draw) - 1)))


class Circuit:
    """Lets no call through for `rest` seconds after `most` failures in a row, and then one call on trial at a time."""

    def __init__(self, most: int = 5, rest: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.rest, self.clock = most, rest, clock
        self.recent: deque[float] = deque(maxlen=most)  # when the last failures in a row happened
        self.guard, self.trial = Lock(), Lock()

    @property
    def closed(self) -> bool:
        return len(self.recent) < self.most

    @contextmanager
    def call(self) -> Iterator[None]:
        """Around one call: a recoverable failure counts, success forgets all failures, others count for nothing."""
        with self.guard:
            on_trial = not self.closed
            if on_trial and (self.clock() - self.recent[-1] < self.rest or not self.trial.acquire(blocking=False)):
                raise CircuitOpen
        try:
            yield
        except Recoverable:
            with self.guard:
                self.recent.append(self.clock())
            raise
        else:
            with self.guard:
                self.recent.clear()
        finally:
            if on_trial:
                self.trial.release()


def resilient(call: Callable[[], object], retry: Retry, circuit: Circuit, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """(result, attempts): recoverable failures are tried again and count against the circuit; others pass through."""
    if retry.attempts < 1:
        raise ValueError("at least one attempt is needed")
    for attempt in count(1):
        try:
            with circuit.call():
                return call(), attempt
        except Recoverable:
            if attempt == retry.attempts:
                raise
        sleep(retry.pause(attempt))


class ResultCache:
    """Results of sources by kind and request, the last `most` stored: frames of written tables, never rows."""

    def __init__(self, most: int = 20):
        self.most = most
        self.frames: OrderedDict = OrderedDict()

    def get(self, branch: Branch) -> DataFrame | None:
        return self.frames.get((branch.kind, fingerprint_of(branch)))

    def put(self, branch: Branch, rows: DataFrame) -> None:
        key = (branch.kind, fingerprint_of(branch))
        self.frames[key] = rows
        self.frames.move_to_end(key)
        while len(self.frames) > self.most:
            self.frames.popitem(last=False)


@dataclass(frozen=True)
class _Asked:
    kind: str
    options: dict


def fingerprint_of(branch: Branch) -> str:
    """Of a branch's kind and options; its name doesn't matter."""
    return fingerprint(_Asked(branch.kind, branch.options))


def attempts_for(plan: Plan, most_calls: int = 10, most_retries: int = 2) -> dict[str, int]:
    """How often each source may be tried: the calls that one try each leaves over go to the branches in order."""
    names = [b.branch_id for b in plan.branches if b.kind in SOURCES]
    spare = max(0, most_calls - len(names))
    # before the k-th branch, k times the most retries have been given away
    return {name: 1 + max(0, min(most_retries, spare - k * most_retries)) for k, name in enumerate(names)}


def written(rows: DataFrame) -> DataFrame:
    """A branch's rows, computed and written down. What Spark fails in may succeed on another attempt."""
    try:
        return stored(rows)
    except AnalysisException:
        raise
    except (PySparkException, Py4JError) as e:
        raise Recoverable(str(e)) from e


def run_plan(
    plan: Plan, runners: dict[str, Callable[[Branch, dict], DataFrame]], cache: ResultCache | None = None, retry: Retry = Retry(), circuits: dict[str, Circuit] | None = None,
    attempts: dict[str, int] | None = None, settle: Callable[[DataFrame], DataFrame] = written,
) -> tuple[dict[str, DataFrame], list[dict]]:
    """(results by branch, outcomes): each branch after those it reads; what reads a failed branch is skipped.

    A branch is retried as a whole: `settle` computes its rows inside the attempt. Sources go into the cache.
    `attempts` allots tries by branch in place of the retry's own number.
    """
    by_id = {b.branch_id: b for b in plan.branches}
    circuits = {} if circuits is None else circuits
    results: dict[str, DataFrame] = {}
    outcomes = []
    for name in plan.order():
        branch = by_id[name]
        held = cache.get(branch) if cache and branch.kind in SOURCES else None
        tries, status, fault = 0, "completed", None
        own = retry if attempts is None else replace(retry, attempts=attempts.get(name, retry.attempts))
        if held is not None:
            results[name] = held
        elif any(d not in results for d in branch.depends_on):
            status = "skipped"
        else:
            inputs = {d: results[d] for d in branch.depends_on}
            try:
                results[name], tries = resilient(lambda: settle(runners[branch.kind](branch, inputs)), own, circuits.setdefault(branch.kind, Circuit()))  # noqa: B023
                if cache and branch.kind in SOURCES:
                    cache.put(branch, results[name])
            except (Recoverable, CircuitOpen, ValueError) as e:
                tries = own.attempts if isinstance(e, Recoverable) else 0
                status, fault = "failed", str(e) or type(e).__name__
        outcomes.append({"branch_id": name, "kind": branch.kind, "status": status, "attempts": tries, "required": branch.required, "fault": fault})
    return results, outcomes


def plotted(plan: Plan) -> set[str]:
    """What a chart of the plan shows: what it names, all calculations, and numbers that no calculation reads."""
    named = {d for b in plan.branches if b.kind == "chart" for d in b.depends_on}
    read = {d for b in plan.branches if b.kind == "calculation" for d in b.depends_on}
    return named | {b.branch_id for b in plan.branches if b.kind == "calculation" or b.kind in NUMERIC and b.branch_id not in read}


def with_default_window(plan: Plan, annual: bool = False, quarterly_growth: bool = False) -> Plan:
    """Charts of growth without dates: growth year over year, quarterly facts and monthly series of a few years.

    `annual` and `quarterly_growth` tell that the question asks for annual or quarter-on-quarter growth by name.
    Branches that state a period keep it. A plan that is changed carries the reason DEFAULT_WINDOW.
    """
    if not any(b.kind == "chart" for b in plan.branches):
        return plan
    shown = plotted(plan)
    growth = [b for b in plan.branches if b.branch_id in shown and b.kind == "calculation" and operation_of(b) in GROWTH]
    sources = {d for b in growth for d in b.depends_on}
    free = lambda b, names: not any(b.options.get(k) for k in names)
    rules = (
        (not annual and not quarterly_growth, [b for b in growth if operation_of(b) != "year_over_year"], lambda b: {"operation": "year_over_year"}),
        (not annual, [b for b in plan.branches if b.kind == "financial_facts" and b.branch_id in sources and free(b, PERIODS)], lambda b: {"period_types": ("quarter",), "limit": max(b.options.get("limit", 0), QUARTERLY_LIMIT)}),
        (bool(growth), [b for b in plan.branches if b.kind == "macro_series" and b.branch_id in shown and free(b, DATES)], lambda b: {"limit": MONTHLY_LIMIT}),
    )
    changes = {b.branch_id: change(b) for holds, chosen, change in rules if holds for b in chosen}
    if not changes:
        return plan
    branches = tuple(replace(b, options=b.options | changes.get(b.branch_id, {})) for b in plan.branches)
    return replace(plan, branches=branches, reasons=tuple(dict.fromkeys((*plan.reasons, DEFAULT_WINDOW))))


def annual_fallback(request: FactRequest, operation: str, run: Callable[[FactRequest], DataFrame]) -> tuple[DataFrame, str | None]:
    """(rows, warning): quarterly facts, or annual ones where there are none and the operation can use them."""
    rows = run(request)
    if request.period_types != ("quarter",) or operation not in ANNUAL_READY or not rows.isEmpty():
        return rows, None
    annual = run(replace(request, period_types=("annual",), fiscal_periods=()))
    return (rows, "annual_financial_fallback_missing") if annual.isEmpty() else (annual, "annual_financial_fallback_used")


def period_override(question: str) -> tuple[date, date] | None:
    """The years that a follow-up names, from the first's first day to the last's last."""
    years = [int(y) for y in re.findall(r"\b20\d{2}\b", question)]
    return (date(min(years), 1, 1), date(max(years), 12, 31)) if years else None


def with_period(plan: Plan, period: tuple[date, date]) -> Plan:
    """The same plan for another period; facts that growth year over year reads begin a year earlier."""
    first, last = period
    early = {d for b in plan.branches if operation_of(b) == "year_over_year" for d in b.depends_on}
    dates = {"financial_facts": ("period_from", "period_to"), "macro_series": ("observed_from", "observed_to")}
    out = []
    for b in plan.branches:
        if b.kind in dates:
            begin = year_earlier(first) if b.branch_id in early else first
            kept = {k: v for k, v in b.options.items() if k not in ("fiscal_years", "fiscal_periods")}
            b = replace(b, options={**kept, dates[b.kind][0]: begin, dates[b.kind][1]: last})
        out.append(b)
    return replace(plan, branches=tuple(out))

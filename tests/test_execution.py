from datetime import date

import pytest

from ledgerlake.plans import execution as X
from ledgerlake.plans.requests import FactRequest
from ledgerlake.plans.research import Branch, Plan, growth_template


def test_pauses_and_circuits():
    retry = X.Retry(first=1, factor=2, longest=3, jitter=0.5)
    assert [retry.pause(k, 0.5) for k in (1, 2, 3)] == [1, 2, 3]
    assert (retry.pause(1, 0.0), retry.pause(1, 1.0)) == (0.5, 1.5)
    now = [0.0]
    circuit = X.Circuit(most=2, rest=10, clock=lambda: now[0])

    def fails():
        raise X.Recoverable

    with pytest.raises(X.CircuitOpen):
        X.resilient(fails, X.Retry(attempts=3), circuit, sleep=lambda s: None)
    now[0] = 11
    assert X.resilient(lambda: 5, X.Retry(), circuit) == (5, 1)
    assert circuit.closed


def test_a_plan_runs_in_order_with_retries_and_cache():
    plan = Plan((Branch("c", "calculation", ("f",)), Branch("f", "financial_facts", options={"k": 1}), Branch("m", "macro_series"), Branch("x", "chart", ("m",))))
    calls = []

    def facts(branch, inputs):
        calls.append(branch.branch_id)
        if len(calls) < 2:
            raise X.Recoverable
        return "rows"

    def macro(branch, inputs):
        raise X.Recoverable

    runners = {"financial_facts": facts, "macro_series": macro, "calculation": lambda b, i: i["f"] + "!"}
    cache = X.ResultCache(most=1)
    same = lambda rows: rows
    results, outcomes = X.run_plan(plan, runners, cache, X.Retry(attempts=2, first=0), settle=same)
    assert results == {"f": "rows", "c": "rows!"}
    assert {o["branch_id"]: (o["status"], o["attempts"]) for o in outcomes} == {"f": ("completed", 2), "c": ("completed", 1), "m": ("failed", 2), "x": ("skipped", 0)}
    assert cache.get(Branch("named otherwise", "financial_facts", options={"k": 1})) == "rows"
    cache.put(Branch("other", "macro_series"), "old")
    cache.put(Branch("f", "financial_facts", options={"k": 1}), "kept")
    results, outcomes = X.run_plan(plan, runners, cache, X.Retry(attempts=1), settle=same)
    assert results["f"] == "kept" and len(calls) == 2 and len(cache.frames) == 1


def test_failures_of_jobs_are_tried_again(spark, tmp_path):
    """Rows are computed inside an attempt, so a job that fails is run again; a plan that is wrong isn't."""
    from pyspark.sql import functions as F

    flag = tmp_path / "failed"

    @F.udf("long")
    def once(x):
        if not flag.exists():
            flag.write_text("x")
            raise RuntimeError("lost")
        return x

    plan = Plan((Branch("f", "financial_facts"),))
    cache = X.ResultCache()
    rows = spark.range(3, numPartitions=1).select(once("id").alias("v"))
    results, outcomes = X.run_plan(plan, {"financial_facts": lambda b, i: rows}, cache, X.Retry(attempts=2, first=0))
    assert sorted(r.v for r in results["f"].collect()) == [0, 1, 2] and outcomes[0]["attempts"] == 2
    assert cache.get(plan.branches[0]).count() == 3


def test_circuits_let_one_call_through_on_trial():
    from threading import Event, Thread

    now = [0.0]
    circuit = X.Circuit(most=1, rest=10, clock=lambda: now[0])
    with pytest.raises(X.Recoverable), circuit.call():
        raise X.Recoverable
    now[0] = 11
    inside, go = Event(), Event()

    def trial():
        with circuit.call():
            inside.set()
            go.wait(5)

    thread = Thread(target=trial)
    thread.start()
    inside.wait(5)
    with pytest.raises(X.CircuitOpen), circuit.call():
        pass
    go.set()
    thread.join()
    assert circuit.closed


def test_attempts_are_allotted_in_order():
    plan = Plan(tuple(Branch(f"s{k}", "financial_facts") for k in range(4)) + (Branch("c", "calculation", ("s0",)),))
    assert X.attempts_for(plan, most_calls=9, most_retries=2) == {"s0": 3, "s1": 3, "s2": 2, "s3": 1}
    assert X.attempts_for(plan, most_calls=2) == {f"s{k}": 1 for k in range(4)}


def test_windows_and_periods():
    plan = growth_template({"a": "A"}, "revenue", limit=5)
    plan = Plan(tuple(Branch(b.branch_id, b.kind, b.depends_on, options={**b.options, "operation": "percentage_change"}) if b.kind == "calculation" else b for b in plan.branches))
    windowed = {b.branch_id: b.options for b in X.with_default_window(plan).branches}
    assert windowed["growth_0"]["operation"] == "year_over_year"
    assert windowed["facts_0"]["period_types"] == ("quarter",) and windowed["facts_0"]["limit"] == 24
    assert X.with_default_window(plan, annual=True) == plan
    assert X.with_default_window(plan).reasons == (X.DEFAULT_WINDOW,)
    loose = Plan((*plan.branches, Branch("m", "macro_series")))
    assert {b.branch_id: b.options for b in X.with_default_window(loose).branches}["m"] == {"limit": 48}
    leap = X.with_period(growth_template({"a": "A"}, "revenue"), (date(2024, 2, 29), date(2024, 12, 31))).branches[0].options
    assert leap["period_from"] == date(2023, 2, 28)
    assert X.period_override("the same for 2021 to 2023") == (date(2021, 1, 1), date(2023, 12, 31))
    assert X.period_override("the same") is None
    moved = X.with_period(growth_template({"a": "A"}, "revenue"), (date(2021, 1, 1), date(2023, 12, 31))).branches[0].options
    assert (moved["period_from"], moved["period_to"]) == (date(2020, 1, 1), date(2023, 12, 31))


def test_annual_fallback(spark):
    rows = {("quarter",): spark.createDataFrame([], "v long"), ("annual",): spark.createDataFrame([(1,)], "v long")}
    run = lambda request: rows[request.period_types]
    got, warning = X.annual_fallback(FactRequest(period_types=("quarter",)), "cagr", run)
    assert got.count() == 1 and warning == "annual_financial_fallback_used"
    assert X.annual_fallback(FactRequest(period_types=("quarter",)), "rolling", run)[1] is None
    assert X.annual_fallback(FactRequest(period_types=("annual",)), "cagr", run)[0].count() == 1

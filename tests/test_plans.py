from datetime import date

import pytest

from ledgerlake.operators.claims import claims_of
from ledgerlake.plans import research as R


def test_plans_are_checked():
    good = R.growth_template({"a": "A", "b": "B"}, "revenue")
    assert R.plan_faults(good, known_companies=frozenset("ab")) == []
    assert R.route_of(good) == "calculation"
    assert good.order()[-1] == "chart"
    assert any("resolved" in x for x in R.plan_faults(good))
    circle = R.Plan((R.Branch("x", "calculation", ("y",)), R.Branch("y", "calculation", ("x",)), R.Branch("y", "chart"), R.Branch("z", "chart", ("q",))))
    told = " ".join(R.plan_faults(circle, needed=("macro_series",)))
    for part in ("repeat", "unknown branches: q", "more than one chart", "numeric sources", "not covered: macro_series"):
        assert part in told
    assert any("circle" in x for x in R.plan_faults(R.Plan((R.Branch("x", "calculation", ("y",)), R.Branch("y", "calculation", ("x",))))))
    assert "budget" in " ".join(R.plan_faults(good, most_sources=1))


def test_normalised_plans_fill_in_companies_and_chart_inputs():
    plan = R.normalised(R.Plan((R.Branch("f", "financial_facts"), R.Branch("m", "macro_series"), R.Branch("g", "calculation", ("f",)), R.Branch("c", "chart"))), ("k",))
    assert plan.branches[0].options == {"company_ids": ("k",)}
    assert plan.branches[3].depends_on == ("m", "g")


@pytest.mark.parametrize(
    "question, strategy",
    [
        (R.Question("Hi!"), "none"),
        (R.Question("revenue", metrics=("revenue",)), "structured_only"),
        (R.Question("why did revenue fall", metrics=("revenue",)), "hybrid"),
        (R.Question("an overview"), "summary_only"),
        (R.Question("name the risks"), "section_level"),
        (R.Question("compare the risks"), "detailed"),
        (R.Question("x", ambiguous=True), "none"),
    ],
)
def test_the_first_rule_decides(question, strategy):
    assert R.plan_retrieval(question).strategy == strategy


def test_retrieval_goes_on_until_the_context_suffices():
    plan = R.plan_retrieval(R.Question("compare", company_ids=("a", "b"), fiscal_years=(2023, 2024), dates=(date(2024, 1, 1),)))
    assert plan.budget == R.COMPARATIVE_BUDGET and plan.filters.period_end_from == date(2024, 1, 1)
    found = {"detailed": ["a"], "section_level": ["a", "b"]}
    asked = []

    def run(strategy, k):
        asked.append((strategy, k))
        return [{"kind": "chunk", "company_id": c, "fiscal_year": y} for c in found[strategy] for y in (2023, 2024)]

    done = R.retrieve_adaptively(plan, run, lambda rows, budget: rows)
    assert not done["abstain"] and asked == [("detailed", 8), ("section_level", 12)]
    assert done["trace"][0]["missing"] == ["companies"]
    assert R.retrieve_adaptively(plan, lambda s, k: [], lambda rows, b: rows)["abstain"]
    assert R.attempts("hybrid", documents_only=True) == ("detailed", "section_level", "summary_only")


def test_outcomes_follow_ups_and_memory():
    plan = R.Plan((R.Branch("a", "macro_series"), R.Branch("b", "chart", required=False)))
    assert [R.outcome(plan, r) for r in ({"a": 1, "b": 1}, {"a": 1}, {"b": 1}, {})] == ["complete", "partial", "partial", "insufficient"]
    merged = R.followed_up(R.Question("x", company_ids=("a",), metrics=("revenue",)), R.Question("y", metrics=("assets",)))
    assert (merged.company_ids, merged.metrics) == (("a",), ("assets",))
    assert [x["v"] for x in R.remembered([{"id": 1, "v": 1}, {"id": 2, "v": 2}], {"id": 1, "v": 3}, "id", 2)] == [2, 3]


def test_claims_are_cut_at_sentences():
    told = claims_of(
        "# Title\n\nAcme Inc. grew 5% vs. 2023. [fact:a] It fell in the U.S. market [fact:b].\n"
        "- Item 1A. Risk Factors name it. Sources:\n| A | B |\n|---|---|\n| x | 3 [fact:c] |\n---\n## In 2024 [fact:d]\nNote"
    )
    assert [(c["text"], c["evidence_ids"], c["material"]) for c in told] == [
        ("Acme Inc. grew 5% vs. 2023.", ["fact:a"], True),
        ("It fell in the U.S. market.", ["fact:b"], True),
        ("Item 1A. Risk Factors name it.", [], True),
        ("Sources:", [], False),
        ("x | 3", ["fact:c"], True),
        ("In 2024", ["fact:d"], True),
        ("Note", [], False),
    ]
    assert [c["sentence_index"] for c in told] == list(range(7))
    # a label of a filing's section ends a sentence unless a name follows it
    assert [c["text"] for c in claims_of("It is told in Item 7. 12% was lost. See Item 7. Risk for more.")] == ["It is told in Item 7.", "12% was lost.", "See Item 7. Risk for more."]
    assert claims_of(None) == [] and claims_of("") == [] and claims_of("[fact:a]") == []

"""Calculations of a plan: the operation's frame of (label, observed_at, value, unit) over its inputs' series.

Inputs are results of fact branches (query_facts) or macro branches (query_macro). Each is first one numeric series;
what an operation can't use is a ValueError that names the fault. Faults are read from one aggregated row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.operators import facts as facts_of, series as S
from ledgerlake.plans.execution import DEFAULT_WINDOW, QUARTERLY_LIMIT
from ledgerlake.plans.research import Branch, Plan, operation_of

POINT = ("label", "observed_at", "value", "unit")
PERCENT = "percent"


def _require(holds: bool, fault: str) -> None:
    if not holds:
        raise ValueError(fault)


def _tally(rows: DataFrame, **asked: Column) -> dict:
    return rows.agg(*[c.alias(k) for k, c in asked.items()]).first().asDict()


def macro_points(rows: DataFrame) -> DataFrame:
    """The values of a macro result that aren't missing."""
    label = F.concat_ws(" ", "series_id", F.col("observed_at").cast("string"))
    return rows.filter("value is not null").select(label.alias("label"), "observed_at", F.col("value").cast("double").alias("value"), "unit")


def fact_points(rows: DataFrame, operation: str, fiscal_years: tuple[int, ...] = ()) -> DataFrame:
    """The facts an operation reads, the latest filing of each observation.

    Growth needs one company, metric and unit: of the last two quarters, or of annual values where there are two, else
    of quarters and year-to-date values that have a partner a year before.
    """
    own = facts_of.latest_filings(rows)
    if operation in ("year_over_year", "quarter_over_quarter"):
        kinds = {k: F.count_if(F.col("period_type") == k) for k in ("quarter", "annual", "year_to_date")}
        n = _tally(own, series=F.count_distinct(F.struct("company_id", "metric", "unit")), **kinds)
        _require(n["series"] == 1, "growth needs exactly one series of a company, metric and unit")
        if operation == "quarter_over_quarter":
            _require(n["quarter"] >= 2, "growth by quarter needs two quarters")
            own = S.latest_points(own.filter("period_type = 'quarter'"), ["company_id"], "period_end", 2)
        elif n["annual"] >= 2:
            own = facts_of.annual_latest(own)
            if fiscal_years:
                own = own.filter(F.year("period_end").between(min(fiscal_years) - 1, max(fiscal_years)))
                _require(_tally(own, n=F.count(F.lit(1)))["n"] >= 2, "growth over a year needs the year before")
        else:
            _require(n["quarter"] + n["year_to_date"] >= 2, "growth over a year needs two comparable values")
            own = own.filter(F.col("period_type").isin("quarter", "year_to_date"))
            day = F.when(F.coalesce(F.col("fiscal_period"), F.lit("")) != "", F.col("fiscal_period")).otherwise(F.date_format("period_end", "MM-dd"))
            pairs = own.groupBy("period_type", day.alias("_day")).agg(F.count(F.lit(1)).alias("n"))
            _require((_tally(pairs, n=F.max("n"))["n"] or 0) >= 2, "growth over a year needs the same period of two years")
    label = F.concat_ws(" ", "company_name", "metric", F.col("period_end").cast("string"))
    return own.select(label.alias("label"), F.col("period_end").alias("observed_at"), F.col("value").cast("double").alias("value"), "unit")


def checked(points: DataFrame, fewest: int, most: int | None = None) -> DataFrame:
    """The series, if it has one unit, no missing value, and as many points as needed."""
    n = _tally(points, n=F.count(F.lit(1)), units=F.count_distinct("unit"), missing=F.count_if(F.col("value").isNull()))
    _require(n["units"] <= 1, "mixed units")
    _require(not n["missing"], "missing values")
    _require(n["n"] >= fewest and (most is None or n["n"] <= most), f"{n['n']} points where {fewest if most is None else f'{fewest} to {most}'} are needed")
    return points


def _ends(points: DataFrame, fewest: int = 2, most: int | None = None) -> DataFrame:
    own = checked(points, fewest, most).groupBy("unit").agg(
        F.min_by("value", "observed_at").alias("first_value"), F.max_by("value", "observed_at").alias("last_value"), F.max_by("label", "observed_at").alias("label"), F.max("observed_at").alias("observed_at")
    )
    return own


def _nonzero(ends: DataFrame, column: str = "first_value") -> DataFrame:
    _require(not _tally(ends, zero=F.count_if(F.col(column) == 0))["zero"], "the base is zero")
    return ends


def _of_ends(value: Callable[[], Column], unit: str | None = None, fewest: int = 2, most: int | None = None, base: bool = True):
    def run(points: list[DataFrame], options: dict) -> DataFrame:
        ends = _ends(points[0], fewest, most)
        ends = _nonzero(ends) if base else ends
        return ends.select("label", "observed_at", value().alias("value"), (F.lit(unit) if unit else F.col("unit")).alias("unit"))

    return run


def _change() -> Column:
    return S.growth_pct(F.col("last_value"), F.col("first_value"))


def _year_over_year(points: list[DataFrame], options: dict) -> DataFrame:
    grown = S.year_over_year_dated(checked(points[0], 2), ["unit"])
    return grown.select("label", "observed_at", F.col("growth").alias("value"), F.lit(PERCENT).alias("unit"))


def _cagr(points: list[DataFrame], options: dict) -> DataFrame:
    _require((options.get("years") or 0) > 0, "the number of years is needed")
    ends = _ends(points[0])
    bad = _tally(ends, n=F.count_if((F.col("first_value") <= 0) | (F.col("last_value") < 0)))["n"]
    _require(not bad, "compound growth needs a positive beginning and no negative end")
    return ends.select("label", "observed_at", S.cagr(F.col("first_value"), F.col("last_value"), F.lit(float(options["years"]))).alias("value"), F.lit(PERCENT).alias("unit"))


def _margin(points: list[DataFrame], options: dict) -> DataFrame:
    above, below = (checked(p, 1, 1) for p in points)
    both = above.crossJoin(below.select(F.col("value").alias("_below"), F.col("unit").alias("_unit")))  # one row each
    n = _tally(both, units=F.count_if(F.col("unit") != F.col("_unit")), zero=F.count_if(F.col("_below") == 0))
    _require(not n["units"], "mixed units")
    _require(not n["zero"], "the base is zero")
    return both.select("label", "observed_at", S.margin(F.col("value"), F.col("_below")).alias("value"), F.lit(PERCENT).alias("unit"))


def _rolling(points: list[DataFrame], options: dict) -> DataFrame:
    window = options.get("window") or 0
    _require(window >= 1, "the window is needed")
    return S.rolling_average(checked(points[0], window), ["unit"], "observed_at", window).select("label", "observed_at", F.col("rolling_avg").alias("value"), "unit")


def _index(points: list[DataFrame], options: dict) -> DataFrame:
    _nonzero(_ends(points[0], 1))
    return S.normalised_index(points[0], ["unit"], "observed_at", float(options.get("base") or 100)).select("label", "observed_at", F.col("index_value").alias("value"), F.lit("index").alias("unit"))


def _correlation(points: list[DataFrame], options: dict) -> DataFrame:
    pairs = S.date_intersection({"x": checked(points[0], 2), "y": checked(points[1], 2)})
    found = S.correlation(pairs, [], "x", "y")
    row = found.first()
    _require(row["n_pairs"] >= 2, "correlation needs two common dates")
    _require(row["correlation"] is not None, "a series is constant")
    last = pairs.agg(F.max("observed_at").alias("observed_at"))
    return found.crossJoin(last).select(F.lit("correlation").alias("label"), "observed_at", F.col("correlation").alias("value"), F.lit("coefficient").alias("unit"))  # one row each


#: Each operation with the number of series it reads.
OPERATIONS: dict[str, tuple[int, Callable[[list[DataFrame], dict], DataFrame]]] = {
    "quarter_over_quarter": (1, _of_ends(_change, PERCENT, 2, 2)),
    "year_over_year": (1, _year_over_year),
    "cagr": (1, _cagr),
    "margin": (2, _margin),
    "absolute_change": (1, _of_ends(lambda: F.col("last_value") - F.col("first_value"), base=False)),
    "percentage_change": (1, _of_ends(_change, PERCENT)),
    "rolling_average": (1, _rolling),
    "normalised_index": (1, _index),
    "correlation": (2, _correlation),
}


def calculated(branch: Branch, inputs: dict[str, DataFrame], kinds: dict[str, Branch], reasons: tuple[str, ...] = ()) -> DataFrame:
    """A calculation branch over the results it reads, in their order; in the default window the latest 24 growths."""
    operation = operation_of(branch)
    _require(operation in OPERATIONS, f"unknown operation {operation}")
    wanted, run = OPERATIONS[operation]
    _require(len(branch.depends_on) >= wanted, f"{operation} reads {wanted} series")
    points = []
    for name in branch.depends_on[:wanted]:
        source = kinds[name]
        points.append(fact_points(inputs[name], operation, source.options.get("fiscal_years", ())) if source.kind == "financial_facts" else macro_points(inputs[name]))
    out = run(points, branch.options).select(*POINT)
    if DEFAULT_WINDOW in reasons and operation == "year_over_year":
        out = S.latest_points(out, ["unit"], "observed_at", QUARTERLY_LIMIT)
    return out


def runners(plan: Plan, facts: Callable[[Branch], DataFrame], macro: Callable[[Branch], DataFrame], documents: Callable[[Branch], DataFrame] | None = None) -> dict[str, Callable[[Branch, dict], DataFrame]]:
    """Runners of all kinds for run_plan: sources by the callables, calculations by their operation, charts as points by series."""
    by_id = {b.branch_id: b for b in plan.branches}

    def chart(branch: Branch, inputs: dict[str, DataFrame]) -> DataFrame:
        out = None
        for name in branch.depends_on:
            kind = by_id[name].kind
            points = inputs[name] if kind == "calculation" else fact_points(inputs[name], "") if kind == "financial_facts" else macro_points(inputs[name])
            part = points.select(F.lit(name).alias("series"), *POINT)
            out = part if out is None else out.unionByName(part)
        _require(out is not None, "a chart plots nothing")
        return out

    def unread(branch: Branch) -> DataFrame:
        raise ValueError("documents can't be read here")

    return {
        "financial_facts": lambda branch, inputs: facts(branch),
        "macro_series": lambda branch, inputs: macro(branch),
        "document_retrieval": lambda branch, inputs: (documents or unread)(branch),
        "calculation": lambda branch, inputs: calculated(branch, inputs, by_id, plan.reasons),
        "chart": chart,
    }

"""Evidence as readers and models see it: deterministic sentences, and compact views with display values.

Rows have evidence_id, kind (financial_fact, macro_observation, calculation or document), summary, company_name,
metric, operation, value (double), unit, period_end, fiscal_year, and points: array of (observed_at, value) of a
calculation. Nulls: a missing name is "The company", a missing metric "metric"; without value or points the sentence
says only that the calculation was made, and other kinds keep their summary. A calculation without points in order of
time takes an undated point only where none has a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.functions.text import display_value, injection_flags, number_display, sanitised

# The wording.
NO_COMPANY, NO_METRIC, NO_OPERATION, NO_PERIODS = "The company", "metric", "calculation", "the available periods"
UNTRUSTED = "untrusted_external_data"


def _company() -> Column:
    return F.coalesce(F.replace("company_name", F.lit("."), F.lit("")), F.lit(NO_COMPANY))


def _metric() -> Column:
    return F.coalesce(F.nullif(F.col("metric"), F.lit("")), F.lit(NO_METRIC))


def _operation() -> Column:
    return F.replace(F.coalesce(F.nullif(F.col("operation"), F.lit("")), F.lit(NO_OPERATION)), F.lit("_"), F.lit(" "))


def _at(day: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" at "), day.cast("string")), F.lit(""))


def _period() -> Column:
    return F.when(F.col("period_end").isNotNull(), _at(F.col("period_end"))).otherwise(F.coalesce(F.concat(F.lit(" in fiscal "), F.col("fiscal_year").cast("string")), F.lit("")))


def _points() -> Column:
    return F.filter(F.coalesce("points", F.array().cast("array<struct<observed_at:date,value:double>>")), lambda p: p["value"].isNotNull())


def covered_period(points: Column) -> Column:
    """First to last date of the points; the date alone where they are one."""
    days = F.array_compact(F.transform(points, lambda p: p["observed_at"]))
    first, last = F.array_min(days), F.array_max(days)
    return F.when(first.isNull(), NO_PERIODS).when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit(" through "), last.cast("string")))


def latest_point(points: Column) -> Column:
    """The point with the latest date, the first of several; points without date only where no other is."""
    return F.reduce(points, F.try_element_at(points, F.lit(1)), lambda best, p: F.when(p["observed_at"] > F.coalesce(best["observed_at"], F.lit("0001-01-01").cast("date")), p).otherwise(best))


def sentence(largest: str = "trillion") -> Column:
    """One sentence for the row, with money in words up to `largest`; null for kinds that are not known."""
    unit = F.coalesce("unit", F.lit(""))
    value, points = display_value(F.col("value"), unit, largest), _points()
    newest = latest_point(points)
    subject = F.concat_ws(" ", _company(), _metric(), _operation())
    series = F.concat(subject, F.lit(" covered "), covered_period(points), F.lit("; latest value was "), display_value(newest["value"], unit, largest), _at(newest["observed_at"]), F.lit("."))
    calculated = F.when(F.col("value").isNotNull(), F.concat(subject, F.lit(" was "), value, _period(), F.lit("."))).when(F.size(points) > 0, series).otherwise(F.concat(subject, F.lit(" was calculated.")))
    fact = F.concat(_company(), F.lit(" "), _metric(), F.lit(" was "), value, _period(), F.lit("."))
    macro = F.concat(F.lit("The macro observation was "), value, _period(), F.lit("."))
    kind = F.col("kind")
    return F.when(kind == "calculation", calculated).when(kind == "financial_fact", F.coalesce(fact, "summary")).when(kind == "macro_observation", F.coalesce(macro, "summary")).when(kind == "document", F.col("summary"))


def compact_view(evidence: DataFrame, largest: str = "trillion") -> DataFrame:
    """evidence_id, kind, summary, display_summary, display_value, and for documents trust and flags of injections.

    Values are shown, not given raw, money in words up to `largest`; documents' texts are cleaned of control characters and marked as not trusted.
    """
    document = F.col("kind") == "document"
    unit = F.coalesce("unit", F.lit(""))
    value = display_value(F.col("value"), unit, largest)
    cleaned = number_display(F.when(document, sanitised("summary")).otherwise(F.col("summary")))
    fact = F.concat(_company(), F.lit(" "), _metric(), F.lit(": "), value, _period())
    macro = F.concat(F.lit("Macro observation: "), value, _period())
    shown = F.when(F.col("kind") == "financial_fact", fact).when(F.col("kind") == "macro_observation", macro).when(F.col("kind") == "calculation", sentence(largest))
    return evidence.select(
        "evidence_id", "kind", cleaned.alias("summary"), F.coalesce(shown, number_display("summary")).alias("display_summary"), value.alias("display_value"),
        F.when(document, UNTRUSTED).alias("trust"), F.when(document, injection_flags("summary")).alias("injection_flags"),
        F.transform(_points(), lambda p: F.struct(p["observed_at"].alias("observed_at"), display_value(p["value"], unit, largest).alias("display_value"))).alias("points"),
    )


def calculation_summary(evidence: DataFrame, largest: str = "trillion") -> DataFrame:
    """(evidence_id, told): what a calculation gave, its latest value, and the time that several values cover."""
    points, unit = _points(), F.coalesce("unit", F.lit(""))
    newest = latest_point(points)
    told = F.concat(display_value(newest["value"], unit, largest), _at(newest["observed_at"]))
    span = covered_period(points)
    covers = F.when(span.contains(" through "), F.concat(F.lit("; covers "), span)).otherwise(F.lit(""))
    one = F.concat(_operation(), F.lit(": "), told)
    several = F.concat(_operation(), F.lit(": latest "), told, covers)
    return evidence.select("evidence_id", F.when(F.size(points) == 0, F.concat(_operation(), F.lit(" was calculated."))).when(F.size(points) == 1, one).otherwise(several).alias("told"))

"""Evaluation: citation metrics, case metrics, gates and category breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.functions.text import ratio


def citation_metrics(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """True and false positives and false negatives over distinct (claim_id, evidence_id); 1 for empty denominators."""
    keys = ["claim_id", "evidence_id"]
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(expected.select(*keys).distinct().withColumn("e", F.lit(1)), keys, "full_outer")
    n = both.agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("true_positives"), F.count_if(F.col("e").isNull()).alias("false_positives"), F.count_if(F.col("p").isNull()).alias("false_negatives"))
    tp = F.col("true_positives")
    return n.withColumns({"precision": ratio(tp, tp + F.col("false_positives")), "recall": ratio(tp, tp + F.col("false_negatives"))})


def case_metrics(cases: DataFrame) -> DataFrame:
    """cases: passed, missing, and one boolean a check (null where it doesn't apply): the share of each over its cases."""
    checks = [c for c, kind in cases.dtypes if kind == "boolean" and c not in ("passed", "missing")]
    share = lambda c: ratio(F.count_if(F.col(c)), F.count(F.col(c)))
    return cases.agg(share("passed").alias("case_pass_rate"), share("missing").alias("missing_rate"), *[share(c).alias(f"{c}_accuracy") for c in checks])


def by_category(cases: DataFrame) -> DataFrame:
    """Cases, passes and failures of each category, in the order in which categories come first."""
    n = cases.groupBy("category").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"))
    return n.withColumns({"failed": F.col("cases") - F.col("passed"), "pass_rate": ratio(F.col("passed"), F.col("cases"))}).orderBy("ord").drop("ord")


def gate_failures(metrics: dict[str, float], minimums: dict[str, float], maximums: dict[str, float]) -> list[str]:
    """What a regression gate finds; a metric that is missing fails."""
    out = [f"{k}: missing" for k in [*minimums, *maximums] if metrics.get(k) is None]
    out += [f"{k}: {metrics[k]} below {v}" for k, v in minimums.items() if metrics.get(k) is not None and metrics[k] < v]
    return out + [f"{k}: {metrics[k]} above {v}" for k, v in maximums.items() if metrics.get(k) is not None and metrics[k] > v]


def budget_failures(cases: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """(case_id, failures) of cases over a budget; a missing number fails."""
    checks = [F.when(F.col(k).isNull(), F.lit(f"{k}_missing")).when(F.col(k) > v, F.lit(f"{k}_over_budget")) for k, v in budgets.items()]
    return cases.select("case_id", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("failures")).filter(F.size("failures") > 0)


def required_and_prohibited(cases: DataFrame) -> DataFrame:
    """Whether all required tools ran and no prohibited one did; cases: required, prohibited, executed arrays."""
    return cases.withColumns({"missing_tools": F.array_except("required", "executed"), "used_prohibited": F.array_intersect("prohibited", "executed")}).withColumn("route_ok", (F.size("missing_tools") == 0) & (F.size("used_prohibited") == 0))


def joined_results(golden: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases with their results where there are any, results without a case)."""
    return golden.join(observed, "case_id", "left"), observed.join(golden, "case_id", "left_anti").orderBy("case_id")


def executed_steps(tools: str, trajectory: str) -> Column:
    """The tools that ran and the nodes that were not skipped, each once; trajectory: array of (node, status)."""
    nodes = F.transform(F.filter(trajectory, lambda s: F.coalesce(s["status"], F.lit("")) != "skipped"), lambda s: s["node"])
    return F.array_union(F.coalesce(tools, F.array().cast("array<string>")), F.coalesce(nodes, F.array().cast("array<string>")))


def matched_companies(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, position, observed_position) of expected companies and the observed one that each is taken for.

    Both have case_id, position, mention, ticker, status, source. Mention or ticker must be equal but for case; the same
    status and source is preferred, then the first observed. Null where none fits. Joined by key, never by case alone.
    """
    keys = F.array_distinct(F.array_compact(F.array(F.lower("mention"), F.lower("ticker"))))
    left = expected.withColumn("key", F.explode(keys)).select("case_id", "position", "key", "status", "source")
    right = observed.select("case_id", F.col("position").alias("observed_position"), F.col("status").alias("_s"), F.col("source").alias("_o"), F.explode(keys).alias("key"))
    alike = F.col("status").eqNullSafe(F.col("_s")) & F.col("source").eqNullSafe(F.col("_o"))
    best = left.join(right, ["case_id", "key"]).groupBy("case_id", "position").agg(F.min(F.struct((~alike).alias("unlike"), "observed_position")).alias("b"))
    return expected.select("case_id", "position").join(best, ["case_id", "position"], "left").select("case_id", "position", F.col("b.observed_position").alias("observed_position"))


def observed_runs(branches: DataFrame) -> DataFrame:
    """One row a case of its branches (case_id, operation, attempts, tool): the operation if there is just one, tools, retries."""
    return branches.groupBy("case_id").agg(
        F.when(F.count_distinct("operation") == 1, F.min("operation")).alias("operation"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.sum(F.greatest(F.lit(0), F.coalesce("attempts", F.lit(0)) - 1)).cast("long").alias("retries"),
    )


def golden_faults(cases: DataFrame) -> DataFrame:
    """(case_id, fault): repeated_id, tools_overlap, no_category; cases: case_id, category, required, prohibited."""
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case_id", F.lit("repeated_id").alias("fault"))
    overlap = cases.filter(F.arrays_overlap("required", "prohibited")).select("case_id", F.lit("tools_overlap").alias("fault"))
    blank = cases.filter(F.coalesce(F.trim("category"), F.lit("")) == "").select("case_id", F.lit("no_category").alias("fault"))
    return repeated.unionByName(overlap).unionByName(blank).distinct()


def golden_summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("cases"))

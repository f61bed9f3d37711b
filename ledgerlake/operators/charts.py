"""Chart datasets: points of several series by date, checks of a dataset as rows, and specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CHART_TYPES = ("line", "bar", "area", "scatter")


def series_points(rows: DataFrame) -> DataFrame:
    """(chart_id, observed_at, values, source_urls): the dates that all of a chart's series have, values by series.

    `rows` has chart_id, series, observed_at, value, source_url, position; rows without date or value are left out.
    Of several rows of a series and date the last by position counts.
    """
    dated = rows.filter("observed_at is not null and value is not null")
    last = dated.groupBy("chart_id", "series", "observed_at").agg(F.max_by(F.struct("value", "source_url"), "position").alias("_p"))
    wanted = rows.groupBy("chart_id").agg(F.count_distinct("series").alias("_wanted"))
    points = last.groupBy("chart_id", "observed_at").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", F.col("_p.value").alias("value"))))).alias("values"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("series", F.col("_p.source_url").alias("u")))), lambda x: x["u"])).alias("source_urls"),
    )
    return points.join(wanted, "chart_id").filter(F.size("values") == F.col("_wanted")).drop("_wanted")


def dataset_faults(series: DataFrame, points: DataFrame) -> DataFrame:
    """(chart_id, fault) of charts whose dataset is unsound; none for sound ones.

    `series` has chart_id, series, label, unit; `points` what series_points returns. Faults: no_points, no_series,
    repeated_series, blank_field, incomplete_point, no_lineage, repeated_date.
    """
    blank = F.coalesce((F.trim("series") == "") | (F.trim("label") == "") | (F.trim("unit") == ""), F.lit(True))
    of_series = series.groupBy("chart_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series").alias("d"), F.bool_or(blank).alias("blank"), F.array_sort(F.collect_set("series")).alias("keys"))
    joined = points.join(of_series.select("chart_id", "keys"), "chart_id", "left")
    of_points = joined.groupBy("chart_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("observed_at").alias("days"),
        F.bool_or(~F.coalesce(F.array_sort(F.map_keys("values")) == F.col("keys"), F.lit(False))).alias("partial"), F.bool_or(F.size(F.coalesce("source_urls", F.array().cast("array<string>"))) == 0).alias("bare"),
    )
    both = of_series.join(of_points, "chart_id", "full")
    faults = F.array(
        F.when(F.col("points").isNull(), F.lit("no_points")), F.when(F.col("n").isNull(), F.lit("no_series")), F.when(F.col("n") > F.col("d"), F.lit("repeated_series")), F.when(F.col("blank"), F.lit("blank_field")),
        F.when(F.col("n").isNotNull() & F.col("partial"), F.lit("incomplete_point")), F.when(F.col("bare"), F.lit("no_lineage")), F.when(F.col("points") > F.col("days"), F.lit("repeated_date")),
    )
    return both.select("chart_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


def mixed_units(rows: DataFrame) -> DataFrame:
    """(chart_id, series, n_units) of series whose rows have several units and so can't be charted."""
    return rows.groupBy("chart_id", "series").agg(F.count_distinct("unit").alias("n_units")).filter("n_units > 1")


def chart_status(points: DataFrame, chart_type: str, n_series: int, fewest: int = 3) -> DataFrame:
    """(chart_id, n_points, status): lines and areas of several series with under three points are partial, without a chart."""
    few = F.lit(chart_type in ("line", "area") and n_series > 1) & (F.col("n_points") < fewest)
    return points.groupBy("chart_id").agg(F.count(F.lit(1)).alias("n_points")).withColumn("status", F.when(few, "partial").otherwise("complete"))


def specifications(series: DataFrame, points: DataFrame, chart_type: str, title: str, x_label: str = "Date") -> DataFrame:
    """One row a chart: type, title, label, series, points in order of date, and their distinct sources in order.

    A chart is shown whole to a reader, so its points are one row; the number of dates bounds it.
    """
    if chart_type not in CHART_TYPES:
        raise ValueError(f"unknown chart type {chart_type}")
    if not title.strip() or not x_label.strip():
        raise ValueError("title and axis label are needed")
    data = points.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("observed_at", "source_urls", F.map_entries("values").alias("values")))).alias("data"))
    keys = series.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("series", "label", "unit"))).alias("series"))
    sources = F.array_distinct(F.flatten(F.transform("data", lambda p: p["source_urls"])))
    return data.join(keys, "chart_id").select("chart_id", F.lit(chart_type).alias("chart_type"), F.lit(title).alias("title"), F.lit(x_label).alias("x_label"), "series", "data", sources.alias("sources"))

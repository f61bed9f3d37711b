"""Dated numeric series: growth, change, rolling and indexed series, correlation, and date alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def growth_pct(current: Column, previous: Column) -> Column:
    """(current / previous - 1) * 100; null where the base is null or zero."""
    return (current / F.when(previous != 0, previous) - 1) * 100


def year_over_year_dated(df: DataFrame, keys: list[str], tolerance_days: int = 7, date: str = "observed_at", value: str = "value", order: str | None = None) -> DataFrame:
    """Growth against the same day a year earlier, else the nearest date within the tolerance in that target's calendar year.

    An exact hit wins, then the smaller distance, then the earlier row. Rows without value, a zero base and
    targets that do not exist (29 February) yield no point. The join is an equi-join on (keys, year), so no
    range join is planned, and both sides are hash-partitioned alike.
    """
    order = order or date
    cur = df.filter(F.col(value).isNotNull()).withColumn("_target", F.add_months(F.col(date), -12)).filter(F.dayofmonth("_target") == F.dayofmonth(date))
    cur = cur.withColumn("_year", F.year("_target"))
    base = df.filter(F.col(value).isNotNull() & (F.col(value) != 0)).select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(date).alias("_b_date"), F.col(value).alias("base_value"), F.col(order).alias("_b_order"))
    on = F.col("_year") == F.year("_b_date")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_b_{key}"))
    gap = F.abs(F.datediff("_b_date", "_target"))
    joined = cur.join(base, on).filter(gap <= tolerance_days)
    if tolerance_days:
        best = W.partitionBy(*keys, date, order).orderBy(gap, "_b_order")
        joined = joined.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1")
    return joined.withColumn("growth", growth_pct(F.col(value), F.col("base_value"))).select(*df.columns, F.col("_b_date").alias("base_at"), "base_value", "growth")


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, values: list[str], keys: list[str]) -> DataFrame:
    """For each left row the latest right row at or before it; null where there is none.

    Union and last-value window: one shuffle on the keys and a sort, no range join, so it stays linear in both
    sides. Without keys the right side is one series, and its rows are dealt by calendar day with the last value
    before each day carried into it, so a task receives a day's rows.
    """
    names = [right_on, *values]
    if not keys:
        return _asof_keyless(left, right, left_on, right_on, names)
    marks = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    nothing = [F.lit(None).cast(right.schema[n].dataType).alias(f"_r_{n}") for n in names]
    lefts = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), *nothing)
    rights = right.select(F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), *keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), *[F.col(n).alias(f"_r_{n}") for n in names])
    both = rights.filter(F.col("_at").isNotNull()).unionByName(lefts)
    found = [F.last(F.when(F.col("_side") == 0, F.struct(*[f"_r_{n}" for n in names])), ignorenulls=True).over(marks).alias("_hit")]
    return both.select("_row", "_side", *found).filter("_side = 1").select("_row.*", *[F.col(f"_hit._r_{n}").alias(n) for n in names])


def _asof_keyless(left: DataFrame, right: DataFrame, left_on: str, right_on: str, names: list[str]) -> DataFrame:
    right = right.filter(F.col(right_on).isNotNull())
    slim = right.select(*names).withColumn("_day", F.to_date(right_on))
    lasts = slim.groupBy("_day").agg(F.max_by(F.struct(*names), right_on).alias("_last"))
    # a row a calendar day that either side has, so the running last value fits one task
    days = lasts.unionByName(left.select(F.to_date(left_on).alias("_day"), F.lit(None).cast(lasts.schema["_last"].dataType).alias("_last")).distinct()).filter("_day is not null")
    before = W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.groupBy("_day").agg(F.first("_last", ignorenulls=True).alias("_last")).select("_day", F.last("_last", ignorenulls=True).over(before).alias("_carry")).filter("_carry is not null")
    rights = slim.unionByName(carried.select("_carry.*", "_day"))
    got = asof_backward(left.withColumn("_day", F.to_date(left_on)), rights, left_on, right_on, [n for n in names if n != right_on], ["_day"])
    return got.drop("_day")


def consecutive_growth(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Growth of each row over the row before it in the series."""
    prev = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("previous_value", prev).withColumn("growth", growth_pct(F.col(value), F.col("previous_value")))


def rolling_average(df: DataFrame, keys: list[str], order: str, size: int, value: str = "value") -> DataFrame:
    """Mean of each full window of `size` rows; rows before the first full window are not emitted."""
    if size < 1:
        raise ValueError("the window needs at least one row")
    frame = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn("rolling_avg", F.avg(value).over(frame)).withColumn("_n", F.count(F.lit(1)).over(frame)).filter(F.col("_n") == size).drop("_n")


def normalised_index(df: DataFrame, keys: list[str], order: str, base: float = 100.0, value: str = "value") -> DataFrame:
    """Each value over the series' first value, times the base; a series whose first value is zero or null yields null."""
    first = F.first(value).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("index_value", F.col(value) / F.when(first != 0, first) * base)


def endpoints(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """First and last value of each series with their order keys, by one partial aggregation."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("n_points")
    )


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Compound annual growth in percent; null unless first > 0, last >= 0 and years > 0."""
    return F.when((first > 0) & (last >= 0) & (years > 0), (F.pow(last / first, 1 / years) - 1) * 100)


def margin(numerator: Column, denominator: Column) -> Column:
    return numerator / F.when(denominator != 0, denominator) * 100


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of aligned pairs; null for fewer than two pairs or a constant side."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    agg = [F.count(F.lit(1)).alias("n_pairs"), F.corr(x, y).alias("_r"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy")]
    got = pairs.groupBy(*keys).agg(*agg) if keys else pairs.agg(*agg)
    return got.withColumn("correlation", F.when((F.col("n_pairs") >= 2) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_r"))).drop("_r", "_sx", "_sy")


def date_intersection(series: dict[str, DataFrame], date: str = "observed_at", value: str = "value") -> DataFrame:
    """Rows for the dates that every series has: one long frame, one pivoting aggregation, no join chain."""
    parts = [df.select(F.lit(name).alias("series"), F.col(date), F.col(value)) for name, df in series.items()]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    pivot = long.groupBy(date).agg(F.count_distinct("series").alias("_n"), *[F.max(F.when(F.col("series") == name, F.col(value))).alias(name) for name in series])
    return pivot.filter(F.col("_n") == len(series)).drop("_n")


def latest_points(df: DataFrame, keys: list[str], order: str, count: int = 8) -> DataFrame:
    """The last `count` rows of each series."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_rn") <= count).drop("_rn")

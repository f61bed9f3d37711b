"""Series in 28 significant digits, against the same long division in whole numbers of SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ledgerlake.catalogue import query
from ledgerlake.functions import decimals as D
from ledgerlake.session import table

PRICE = "decimal(28,6)"


def _sql(pairs: str, keys: str, less: bool, shift: int) -> str:
    """Text of a / b (less 1) times 10 ** shift, for positive whole numbers a and b of `pairs` (keys, a, b)."""
    ten = lambda n: f"CAST('1' || repeat('0', CAST({n} AS INTEGER)) AS HUGEINT)"
    cut = lambda c: f"len(CAST(abs({c}) AS VARCHAR)) - 28"
    up = lambda c, more: f"CASE WHEN k <= 0 THEN {c} ELSE sign({c})::HUGEINT * (abs({c}) // {ten('k')} + CASE WHEN 2 * (abs({c}) % {ten('k')}) > {ten('k')} OR 2 * (abs({c}) % {ten('k')}) = {ten('k')} AND ({more} OR (abs({c}) // {ten('k')}) % 2 = 1) THEN 1 ELSE 0 END) END"
    step = lambda n: f"s{n} AS (SELECT *, r{n - 1} * 10000000000 // d AS q{n}, r{n - 1} * 10000000000 % d AS r{n} FROM s{n - 1})"
    return f"""WITH p AS ({pairs}), n AS (SELECT {keys}, a * {ten('28 - len(CAST(a AS VARCHAR))')} AS n, b * {ten('28 - len(CAST(b AS VARCHAR))')} AS d, len(CAST(a AS VARCHAR)) - len(CAST(b AS VARCHAR)) AS e FROM p),
s0 AS (SELECT *, n // d AS q0, n % d AS r0 FROM n), {step(1)}, {step(2)}, {step(3)}, w AS (SELECT {keys}, e, r3 <> 0 AS more, ((q0 * 10000000000 + q1) * 10000000000 + q2) * 10000000000 + q3 AS q FROM s3),
x AS (SELECT *, {cut('q')} AS k FROM w), y AS (SELECT {keys}, {up('q', 'more')} AS c, e - 30 + greatest(k, 0) AS e FROM x), z AS (SELECT {keys}, e, {f"c - {ten('-e')}" if less else "c"} AS c FROM y),
u AS (SELECT *, {cut('c')} AS k FROM z), v AS (SELECT {keys}, {up('c', 'false')} AS c, {shift} + e + greatest(k, 0) AS e FROM u), t AS (SELECT {keys}, c, greatest(-e, 0) AS e, lpad(CAST(abs(c) AS VARCHAR), CAST(greatest(1 - e, len(CAST(abs(c) AS VARCHAR))) AS INTEGER), '0') AS s FROM v)
SELECT {keys}, CASE WHEN c < 0 THEN '-' ELSE '' END || s[1:len(s) - e] || CASE WHEN regexp_matches(s[len(s) - e + 1:], '[1-9]') THEN '.' || regexp_replace(s[len(s) - e + 1:], '0+$', '') ELSE '' END AS value FROM t"""


_CENTS = "CAST(round(o_totalprice * 100) AS HUGEINT)"


def prices(spark, sf):
    own = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).cast(PRICE).alias("price"))
    return rows, own


@query("f29_growth", _sql(f"SELECT o_orderkey, {_CENTS} AS a, lag({_CENTS}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders QUALIFY b IS NOT NULL", "o_orderkey", True, 2))
def f29_growth(spark, sf):
    """Growth from each customer's order before, in percent."""
    rows, own = prices(spark, sf)
    both = rows.withColumn("before", F.lag("price").over(own)).filter("before is not null")
    return both.select("o_orderkey", D.growth_text("price", "before").alias("value"))


@query("f29_index", _sql(f"SELECT o_orderkey, {_CENTS} AS a, first({_CENTS}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders", "o_orderkey", False, 2))
def f29_index(spark, sf):
    """Each customer's orders as an index of the first, which is 100."""
    rows, own = prices(spark, sf)
    return rows.withColumn("base", F.first("price").over(own)).select("o_orderkey", D.percent_text("price", "base").alias("value"))


@query("f29_rolling_average", _sql(f"SELECT o_orderkey, sum({_CENTS}) OVER w AS a, CAST(300 AS HUGEINT) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) QUALIFY count(*) OVER w = 3", "o_orderkey", False, 0))
def f29_rolling(spark, sf):
    """Means of three orders of a customer."""
    rows, own = prices(spark, sf)
    three = own.rowsBetween(-2, 0)
    held = rows.withColumns({"total": F.sum("price").over(three), "n": F.count("price").over(three)}).filter("n = 3")
    return held.select("o_orderkey", D.ratio_text("total", F.lit(3).cast(PRICE)).alias("value"))


@query("f29_margin", _sql("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS HUGEINT) AS a, CAST(round(l_extendedprice * 100) AS HUGEINT) AS b FROM lineitem WHERE round(l_extendedprice * (1 - l_discount) * 100) > 0", "l_orderkey, l_linenumber", False, 2))
def f29_margin(spark, sf):
    """What is left of each line's price after its discount, in percent; both in cents."""
    cents = lambda x: F.round(x * 100).cast(PRICE)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), cents(F.col("l_extendedprice")).alias("b")).filter("a > 0")
    return rows.select("l_orderkey", "l_linenumber", D.percent_text("a", "b").alias("value"))


@query("f29_cagr")
def f29_cagr(spark, sf):
    """Compound growth from each customer's first order to the last, by the years between; tests compare with Python's decimals."""
    place = F.struct("o_orderdate", "o_orderkey")
    price = F.round("o_totalprice", 2).cast(PRICE)
    ends = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(price, place).alias("first"), F.max_by(price, place).alias("last"), (F.year(F.max("o_orderdate")) - F.year(F.min("o_orderdate"))).cast("decimal(10,0)").alias("years"))
    return ends.select("o_custkey", "first", "last", "years", D.compound_growth("last", "first", "years").alias("value"))

"""Arithmetic of 28 significant digits, half even, as columns: what a decimal context of that precision gives.

A number is a struct (digits, exponent): an integer of at most 28 digits, as decimal(38, 0), times a power of ten. Quotients
come ten digits a step from exact remainders, which fit 38 digits, so no step rounds but the last. A null operand gives
null, and so does a zero divisor. These are Spark's own expressions, for further expressions to build on. Powers, which no
built-in has to more than 15 digits, and quotients that are shown at once are Arrow functions over Python's decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ledgerlake.functions.text import let

PLACES = 28
WHOLE = "decimal(38,0)"


def power_of_ten(n: Column) -> Column:
    """10 ** n as a whole number, for n of at most 37."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast(WHOLE)


def number(value: Column, scale: int = 6) -> Column:
    """A decimal of up to `scale` places as (digits, exponent)."""
    whole = F.replace(value.cast(f"decimal(38,{scale})").cast("string"), F.lit("."), F.lit("")).cast(WHOLE)
    return F.when(value.isNotNull(), F.struct(whole.alias("digits"), F.lit(-scale).alias("exponent")))


def rounded(digits: Column, exponent: Column, more: Column | None = None) -> Column:
    """digits * 10 ** exponent at 28 significant digits, half even; `more` says whether something beyond the digits isn't zero."""
    more = F.lit(False) if more is None else more

    def cut(text: Column) -> Column:
        head, tail = F.substring(text, 1, PLACES), F.substring(text, PLACES + 1, 38)
        half = F.rpad(F.lit("5"), F.length(tail), F.lit("0"))
        up = (tail > half) | ((tail == half) & (more | (F.substring(head, PLACES, 1).cast("int") % 2 == 1)))
        kept = F.when(F.length(tail) == 0, text.cast(WHOLE)).otherwise(head.cast(WHOLE) + F.when(up, 1).otherwise(0))
        return F.struct((kept * F.signum(digits).cast("int")).cast(WHOLE).alias("digits"), (exponent + F.length(tail)).cast("int").alias("exponent"))

    return let(F.abs(digits).cast("string"), cut)


def ratio(a: Column, b: Column) -> Column:
    """a / b of two numbers."""
    size = lambda x: F.length(F.abs(x["digits"]).cast("string"))

    def divide(s: Column) -> Column:
        # both at 28 digits, so the quotient lies between a tenth and ten
        low = s["d"]

        def step(have: Column, _: Column) -> Column:
            grown = (have["r"] * F.lit(10**10).cast("decimal(11,0)")).cast(WHOLE)
            return F.struct((have["q"] * F.lit(10**10).cast("decimal(11,0)") + F.call_function("div", grown, low)).cast(WHOLE).alias("q"), (grown % low).cast(WHOLE).alias("r"))

        first = F.struct(F.call_function("div", s["n"], low).cast(WHOLE).alias("q"), (s["n"] % low).cast(WHOLE).alias("r"))
        done = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), first, step)
        return let(done, lambda x: rounded((x["q"] * s["sign"]).cast(WHOLE), s["e"] - 30, x["r"] != 0))

    scaled = lambda x: (F.abs(x["digits"]) * power_of_ten(F.lit(PLACES) - size(x)).cast("decimal(28,0)")).cast(WHOLE)
    parts = F.struct(
        scaled(a).alias("n"), scaled(b).alias("d"), (F.signum(a["digits"]) * F.signum(b["digits"])).cast("int").alias("sign"),
        ((a["exponent"] - (F.lit(PLACES) - size(a))) - (b["exponent"] - (F.lit(PLACES) - size(b)))).alias("e"),
    )
    zero = F.struct(F.lit(0).cast(WHOLE).alias("digits"), F.lit(0).alias("exponent"))
    return F.when(a.isNull() | b.isNull() | (b["digits"] == 0), None).when(a["digits"] == 0, zero).otherwise(let(parts, divide))


def less_one(a: Column) -> Column:
    """a - 1."""

    def minus(x: Column) -> Column:
        places = -x["exponent"]
        # below 1e-9 only the sign of what lies beyond 37 places matters
        far = F.greatest(places - 37, F.lit(0))
        text = F.abs(x["digits"]).cast("string")
        shown = F.lpad(text, 60, "0")
        held = F.when(far > 0, F.left(shown, F.lit(60) - far).cast(WHOLE)).otherwise(F.abs(x["digits"]))
        lost = (far > 0) & F.right(shown, far).rlike("[1-9]")
        one = power_of_ten(F.least(F.greatest(places, F.lit(0)), F.lit(37)))
        own = (held * power_of_ten(F.greatest(-places, F.lit(0)))).cast(WHOLE)
        # 1 - a with a tail beyond the digits is one unit less and a tail of its own
        whole = F.when(F.signum(x["digits"]) < 0, -(one + own)).otherwise(own - one + F.when(lost & (own < one), 1).otherwise(0))
        return rounded(whole.cast(WHOLE), F.when(places > 37, -37).when(places < 0, 0).otherwise(x["exponent"]), lost)

    return F.when(a.isNotNull(), let(a, minus))


def times_ten(a: Column, n: int) -> Column:
    """a * 10 ** n, which is exact."""
    return F.when(a.isNotNull(), F.struct(a["digits"].alias("digits"), (a["exponent"] + n).alias("exponent")))


def plain(a: Column) -> Column:
    """A number as text, without exponent and without zeros at the end of its fraction."""

    def shown(x: Column) -> Column:
        text = F.abs(x["digits"]).cast("string")
        places = F.greatest(-x["exponent"], F.lit(0))
        long = F.lpad(F.concat(text, F.repeat(F.lit("0"), F.greatest(x["exponent"], F.lit(0)))), F.greatest(places + 1, F.length(text) + F.greatest(x["exponent"], F.lit(0))), F.lit("0"))
        head, tail = F.left(long, F.length(long) - places), F.regexp_replace(F.when(places > 0, F.right(long, places)).otherwise(F.lit("")), "0+$", "")
        return F.concat(F.when(F.signum(x["digits"]) < 0, "-").otherwise(""), head, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))

    return F.when(a.isNotNull(), let(a, shown))


def growth(current: Column, previous: Column) -> Column:
    """(current / previous - 1) * 100."""
    return times_ten(less_one(ratio(current, previous)), 2)


def context_text(value: Decimal) -> str:
    """A decimal as `plain` shows it."""
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def _texts(current: pd.Series, previous: pd.Series, of: Callable[[Decimal], Decimal], shift: int) -> pd.Series:
    with localcontext(prec=PLACES, rounding=ROUND_HALF_EVEN):
        return pd.Series([None if a is None or b is None or not b else context_text(of(a / b).scaleb(shift)) for a, b in zip(current, previous, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def growth_text(current: pd.Series, previous: pd.Series) -> pd.Series:
    """(current / previous - 1) * 100 as text, as `plain` shows `growth`; a batch at once, for rows of large tables."""
    return _texts(current, previous, lambda x: x - 1, 2)


@F.pandas_udf(T.StringType())
def percent_text(part: pd.Series, whole: pd.Series) -> pd.Series:
    """part / whole * 100 as text."""
    return _texts(part, whole, lambda x: x, 2)


@F.pandas_udf(T.StringType())
def ratio_text(part: pd.Series, whole: pd.Series) -> pd.Series:
    """part / whole as text."""
    return _texts(part, whole, lambda x: x, 0)


@F.pandas_udf(T.StringType())
def compound_growth(end: pd.Series, start: pd.Series, years: pd.Series) -> pd.Series:
    """((end / start) ** (1 / years) - 1) * 100 as text; null unless start and years are above zero and end isn't below."""

    def one(e: Decimal | None, s: Decimal | None, y: Decimal | None) -> str | None:
        if e is None or s is None or y is None or s <= 0 or e < 0 or y <= 0:
            return None
        with localcontext(prec=PLACES, rounding=ROUND_HALF_EVEN):
            try:
                return context_text(((e / s) ** (Decimal(1) / y) - 1) * 100)
            except InvalidOperation:
                return None

    return pd.Series([one(*row) for row in zip(end, start, years, strict=True)], dtype=object)

"""28 significant digits against Python's decimals, digit by digit."""

import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from ledgerlake.functions import decimals as D
from ledgerlake.queries import decimals as Q


def test_quotients_and_growth_equal_decimals(spark):
    rng = random.Random(1)
    some = lambda: (Decimal(rng.randrange(-(10 ** rng.randrange(1, 22)), 10 ** rng.randrange(1, 22))) / 10 ** rng.randrange(0, 7)).quantize(Decimal("0.000001"))
    rows = [(k, some(), some()) for k in range(3000)]
    ends = [Decimal(0), Decimal(1), Decimal(-1), Decimal("0.000001"), Decimal(10) ** 20, Decimal("9" * 21), Decimal(80), Decimal(3), Decimal("1.5"), None]
    rows += [(4000 + 20 * i + j, a, b) for i, a in enumerate(ends) for j, b in enumerate(ends)]
    a, b = D.number(F.col("a")), D.number(F.col("b"))
    df = spark.createDataFrame(rows, "k int, a decimal(28,6), b decimal(28,6)").withColumn("digits", F.lit("clash"))
    for r in df.select("a", "b", D.plain(D.ratio(a, b)).alias("q"), D.plain(D.growth(a, b)).alias("g"), D.plain(a).alias("p")).collect():
        assert r.p == (None if r.a is None else D.context_text(r.a))
        if r.a is None or r.b is None or r.b == 0:
            assert r.q is None and r.g is None
            continue
        with localcontext(prec=28):
            q = r.a / r.b
            assert (r.q, r.g) == (D.context_text(q), D.context_text((q - 1) * 100))


def test_halves_go_to_the_even_digit(spark):
    texts = ["1234567890123456789012345678" + t for t in ("5", "50", "51", "49", "500001")] + ["1234567890123456789012345677" + t for t in ("5", "4999", "5000")] + ["9" * 28 + "5", "7"]
    df = spark.createDataFrame([(t, Decimal(t)) for t in texts], "t string, d decimal(38,0)")
    with localcontext(prec=28):
        want = {t: D.context_text(+Decimal(t)) for t in texts}
    assert {r.t: r.v for r in df.select("t", D.plain(D.rounded(F.col("d"), F.lit(0))).alias("v")).collect()} == want
    more = df.select("t", D.plain(D.rounded(F.col("d"), F.lit(0), F.lit(True))).alias("v")).collect()
    assert {r.t: r.v for r in more}[texts[0]].endswith("790") and texts[0][27] == "8"


def test_published_growth(spark):
    """Annual values of a known series, as the reference's own tests have them."""
    values = ["975241000", "1296745000", "1669626000", "2167937000"]
    df = spark.createDataFrame([(Decimal(b), Decimal(a)) for a, b in zip(values, values[1:])], "b decimal(28,6), a decimal(28,6)")
    got = [r.g for r in df.select(D.plain(D.growth(D.number(F.col("b")), D.number(F.col("a")))).alias("g")).collect()]
    with localcontext(prec=28):
        assert got == [D.context_text((Decimal(b) / Decimal(a) - 1) * 100) for a, b in zip(values, values[1:])]
    assert [g[:4] for g in got] == ["32.9", "28.7", "29.8"]


def test_compound_growth_equals_decimals(spark, sf):
    rows = Q.f29_cagr(spark, sf).collect()
    assert len(rows) > 50
    for r in rows:
        with localcontext(prec=28):
            assert r.value == (None if r.years <= 0 else D.context_text(((r.last / r.first) ** (Decimal(1) / r.years) - 1) * 100))

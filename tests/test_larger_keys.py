"""Queries against their SQL where keys and values are as large as in tables many times the tests'."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlake import catalogue, queries as _  # noqa: F401


def differences(spark, folder, name):
    """(rows only of the query, rows only of its SQL)"""
    con = duckdb.connect()
    for path in folder.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) > 0
    return set(got) - set(want), set(want) - set(got)


@pytest.mark.parametrize("name", ["f15_f16_display", "c17_sentences", "c15_compact_view", "c17_calculation_summaries"])
def test_sums_over_a_billion(spark, sf, tmp_path, name):
    shift = 122_070  # times 8192: just below 1e9
    spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_custkey", F.col("c_custkey") + shift).write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_custkey", F.col("o_custkey") + shift).write.parquet(str(tmp_path / "orders.parquet"))
    assert differences(spark, tmp_path, name) == (set(), set())


@pytest.mark.parametrize("name", ["c6_c7_c8_c9_c10_issues", "c6_answers_valid"])
def test_amounts_that_look_like_years(spark, tmp_path, name):
    """Wrong sums (key 3 modulo 8) told as 1997 and 2017, the year's own among them, and a right one of another year."""
    rows = [(3, 1, 995.0, 1998), (11, 1, 1005.0, 1998), (19, 2, 996.0, 1999), (1, 2, 2005.0, 1996), (8, 3, 1998.0, 1998), (9, 3, 2004.0, 1995), (16, 3, 1990.0, 1995)]
    orders = spark.createDataFrame([(k, c, v, datetime(y, 5, 1)) for k, c, v, y in rows], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert differences(spark, tmp_path, name) == (set(), set())


def test_years_and_amounts(spark):
    from ledgerlake.operators.claims import stated_numbers, stated_years

    units = F.array(F.lit("usd"), F.lit("usd shares"))
    rows = spark.createDataFrame([("Made 2017 USD in 1998, 2,001 and $1999.",), ("From 2010 to 2012 by 2011% and 2013 percent; 2014 usdx, 5 USD/shares.",), ("In 2015: 2015 million, € 2016.",), ("No year.",)], "text string")
    got = [(r.y, [n.value for n in r.n]) for r in rows.select(stated_years(F.col("text"), units).alias("y"), stated_numbers(F.col("text"), units).alias("n")).collect()]
    assert got == [(["1998"], [2017.0, 2001.0, 1999.0]), (["2010", "2012", "2014"], [2011.0, 2013.0, 5.0]), (["2015", "2015"], [2015e6, 2016.0]), ([], [])]


def test_labels_keep_their_letters(spark, tmp_path):
    """ß is no ss in the query's SQL; a text of capitals names the label of small letters."""
    spark.createDataFrame([(1, "Enlich schß ö mehr"), (2, "erSSie entech und"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(1, "ein ENLICH  schß, Ö und mehr"), (2, "enlich schss ö"), (3, "ERSSIE-entech"), (4, "erßie entech"), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, tmp_path, "e2_e3_e4_label_matches") == (set(), set())

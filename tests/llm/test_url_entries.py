"""URL filters whose models have more entries than are broadcast."""

import pytest

from ledgerlake.llm import urls


def test_no_entry_is_lost_beyond_the_broadcast(spark, sf):
    """A table of entries that isn't broadcast gives every URL the ratio, rule and verdict of one that is."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "http://a.org/é"), (-4, "http://a.org/é"), (-5, "no host")], "page_id long, url string")
    rows = pages.unionByName(odd)
    whole = {r.page_id: r for r in urls.judge(rows).collect()}
    joined = {r.page_id: r for r in urls.judge(rows, most=10).collect()}
    assert joined.keys() == whole.keys() and len(whole) == rows.count()
    for key, row in whole.items():
        assert joined[key].ratio == pytest.approx(row.ratio, abs=1e-12)
        assert (joined[key].rule, joined[key].verdict) == (row.rule, row.verdict)

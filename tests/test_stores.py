"""Tables published by manifest, and artifacts by content."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import runs as R
from ledgerlake.sources import artifact_store as A
from ledgerlake.sources.store import Store


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, {"a": "k long, v string", "b": "k long"}, str(tmp_path / "store"))
    one = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    broken = one.select(F.raise_error(F.lit("no")).cast("long").alias("k"))
    with pytest.raises(Exception, match="no"):
        store.publish("first", {"a": one, "b": broken})
    assert store.table("a").count() == store.table("b").count() == 0 and not store.published("first")
    store.publish("first", {"a": one, "b": one.select("k")})
    store.publish("first", {"a": one, "b": one.select("k")})
    store.publish("second", {"a": spark.createDataFrame([(2, "z"), (3, None)], "k long, v string"), "b": one.filter("false").select("k")})
    again = Store(spark, store.tables, store.root)
    assert sorted((r.k, r.v, r["_run"]) for r in again.table("a").collect()) == [(1, "x", 1), (2, "y", 1), (2, "z", 2), (3, None, 2)]
    assert sorted(tuple(r) for r in again.latest("a", ["k"]).collect()) == [(1, "x"), (2, "z"), (3, None)] and again.table("b").count() == 2


def test_macro_run_of_odd_items(spark, tmp_path):
    store = Store(spark, R.TABLES, str(tmp_path / "store"))
    told = '{"seriess": [{"id": "x", "units_short": "u"}]}'
    seen = '{"observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-01-01", "value": "2"}, {"date": "bad", "value": "3"}, {"date": "2024-01-02", "value": "."}]}'
    items = [("x", told, seen), (None, told, seen), ("n", None, seen), ("m", told, None), ("k", '{"seriess": []}', seen), ("j", told, '{"observations": 1}')]
    frame = spark.createDataFrame(items, "series_id string, metadata string, observations string").withColumn("value", F.lit("clash")).withColumn("unit", F.lit(1))
    R.macro_run(store, "1", frame)
    R.macro_run(store, "2", frame.filter("false"))
    assert sorted((r.series_id, str(r.observed_at), None if r.value is None else float(r.value), r.unit) for r in store.table("observations").collect()) == [("X", "2024-01-01", 2.0, "u"), ("X", "2024-01-02", None, "u")]
    got = {r.run: r for r in store.table("runs").collect()}
    assert (got["1"].status, got["1"].inserted, got["1"].missing, got["1"].failures) == ("partial_failed", 2, 1, 5) and (got["2"].status, got["2"].rows_seen) == ("success", 0)
    assert sorted((r.item or "", r.message) for r in store.table("failures").collect()) == [("", "no series"), ("j", "no observations"), ("k", "no metadata"), ("m", "no observations"), ("n", "no metadata")]


def test_artifacts_are_put_once(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", b"one"), ("b", b"one"), ("c", b""), ("a", b"two")], "path string, content binary")
    A.add(spark, root, rows.repartition(3))
    top = max(hashlib.sha256(x).hexdigest() for x in (b"one", b"two"))
    held = {r.path: (r.content_hash, r.size_bytes, bytes(r.content), r.n_loads) for r in A.contents(spark, root, A.references(spark, root)).collect()}
    assert {k: v[0] for k, v in held.items()} == {"a": top, "b": hashlib.sha256(b"one").hexdigest(), "c": hashlib.sha256(b"").hexdigest()}
    assert held["c"] == (hashlib.sha256(b"").hexdigest(), 0, b"", 1)
    files = sorted(p.name for p in (tmp_path / "store/objects").rglob("*") if p.is_file())
    A.add(spark, root, rows)
    assert sorted(p.name for p in (tmp_path / "store/objects").rglob("*") if p.is_file()) == files and all(r.n_loads == 1 for r in A.references(spark, root).collect())


def test_a_failed_load_names_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    spark.dataSource.register(A.ArtifactStore)
    rows = spark.createDataFrame([("a", b"one"), ("b", None)], "path string, content binary")
    with pytest.raises(Exception, match="path and content"):
        rows.coalesce(1).write.format("artifact_store").option("root", root).mode("append").save()
    assert A.references(spark, root).count() == 0 and not list((tmp_path / "store/pending").iterdir())
    with pytest.raises(Exception, match="only ever added"):
        rows.write.format("artifact_store").option("root", root).mode("overwrite").save()

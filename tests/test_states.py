import glob
import os
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.stores import line_blocks
from ledgerlake.streaming import states as S
from ledgerlake.streaming.events import event_stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def finished(stream, folder, name):
    run = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    run.awaitTermination(180)
    assert run.exception() is None
    return stream.sparkSession.table(name).collect()


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The events of a few users, as files of a log."""
    folder = str(tmp_path_factory.mktemp("log"))
    rows = spark.read.parquet(EVENTS).withColumn("user_id", F.col("user_id") % 5)
    rows.coalesce(1).write.parquet(f"{folder}/all/events.parquet")
    return folder, rows


def test_lease_steps():
    assert S.lease_step(None, 0, "a", "acquire", 10, 5) == ("a", 15, True)
    assert S.lease_step("a", 15, "b", "acquire", 14, 5) == ("a", 15, False)
    assert S.lease_step("a", 15, "b", "acquire", 15, 5) == ("b", 20, True)
    assert S.lease_step("a", 15, "a", "renew", 14, 5) == ("a", 19, True)
    assert S.lease_step("a", 15, "a", "renew", 16, 5) == ("a", 15, False)
    assert S.lease_step("a", 15, "b", "release", 14, 5) == ("a", 15, False)
    assert S.lease_step("a", 15, "a", "release", 14, 5) == (None, 0.0, True)


def test_run_steps():
    assert S.run_step(None, "running") == ("", False)
    assert S.run_step(None, "queued") == ("queued", True)
    assert S.run_step("queued", "running") == ("running", True)
    assert S.run_step("completed", "failed") == ("completed", False)
    assert S.run_step("running", "unknown") == ("running", False)


def test_leases_stream(spark, log, tmp_path):
    folder, rows = log
    action = {"view": "acquire", "click": "renew", "purchase": "release"}
    named = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in action.items()], F.lit("acquire"))
    stream = event_stream(spark, f"{folder}/all/*", rows.schema, "*.parquet").withColumns({"action": named, "worker": F.concat(F.lit("w"), F.col("event_id") % 3)})
    got = finished(S.leases(stream, "user_id", "worker", "action", "ts", 3600.0), tmp_path, "leases")
    held = defaultdict(lambda: (None, 0.0))
    want = []
    plain = rows.withColumns({"action": named, "worker": F.concat(F.lit("w"), F.col("event_id") % 3), "at": F.col("ts").cast("timestamp").cast("double")})
    for r in sorted(plain.collect(), key=lambda r: (r["at"], r["worker"], r["action"])):
        who, until, yes = S.lease_step(*held[r.user_id], r.worker, r.action, r["at"], 3600.0)
        held[r.user_id] = (who, until)
        want.append((str(r.user_id), r.worker, r.action, r["at"], yes, who))
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r.granted for r in got} == {True, False}


def test_runs_stream_once_terminal_and_time_out(spark, tmp_path):
    rows = [("a", "queued", 0), ("a", "running", 10), ("a", "completed", 20), ("a", "failed", 30), ("b", "queued", 0), ("b", "running", 5), ("c", "running", 1)]
    late = [("z", "queued", 5000)]
    for k, part in enumerate((rows, late, [("z", "running", 5001)])):
        spark.createDataFrame(part, "run string, status string, at long").select("run", "status", F.timestamp_seconds(F.col("at") + 1_000_000).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
        for name in glob.glob(f"{tmp_path}/in/{k}.parquet/part-*"):
            os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))  # the stream takes files by age
    stream = spark.readStream.schema("run string, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r.key, r.before, r.after) for r in finished(S.run_states(stream, "run", "status", "ts", 100.0, "1 second"), tmp_path, "runs")}
    assert {("a", None, "queued"), ("a", "queued", "running"), ("a", "running", "completed"), ("b", "running", "timed_out")} <= got
    assert not [x for x in got if x[0] == "c" or x[2] == "failed" or (x[0] == "a" and x[2] == "timed_out")]


def test_state_changes_stream(spark, log, tmp_path):
    folder, rows = log
    stream = event_stream(spark, f"{folder}/all/*", rows.schema, "*.parquet")
    got = finished(S.state_changes(stream, "user_id", ("event_type",), "ts"), tmp_path, "changes")
    at = rows.withColumn("at", F.col("ts").cast("timestamp").cast("double")).toPandas().sort_values("at", kind="stable")
    assert at.groupby("user_id")["at"].apply(lambda s: s.is_unique).all()
    before = at.groupby("user_id")["event_type"].shift()
    moved = at[before != at["event_type"]]
    assert len(got) == len(moved)
    assert sorted((r.key, r.at, r.after) for r in got) == sorted(zip(moved["user_id"].astype(str), moved["at"], moved["event_type"], strict=True))


def test_lines_of_a_page(spark):
    words = pd.DataFrame([(1, "b", 20.0, 10.5, 25.0, 12.0), (1, "a", 1.0, 10.0, 9.0, 12.0), (1, "c", 30.0, 13.0, 33.0, 14.0), (1, "d", 1.0, 13.1, 5.0, 15.0), (2, "x", 0.0, 0.0, 1.0, 1.0)], columns=["page_id", "text", "x0", "top", "x1", "bottom"])
    got = line_blocks(spark.createDataFrame(words)).orderBy("page_id", "line").collect()
    # the third word lies 3.0 below the first, so it still belongs to its line; the fourth does not
    assert [(r.page_id, r.line, r.text, r.x0, r.x1, r.bottom) for r in got] == [(1, 0, "a b c", 1.0, 33.0, 14.0), (1, 1, "d", 1.0, 5.0, 15.0), (2, 0, "x", 0.0, 1.0, 1.0)]

"""Stateful processors over the whole event log, across a restart, against the plain steps."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.queries import streams as Q
from ledgerlake.session import table
from ledgerlake.streaming.processors import lease_now, run_now
from ledgerlake.streaming.states import lease_step, run_step


def test_catching_up():
    assert lease_now("a", 10.0, 9.9) == ("a", 10.0) and lease_now("a", 10.0, 10.0) == (None, 0.0) == lease_now(None, 0.0, 1.0)
    assert run_now("running", 10.0, 9.0, 5.0) == ("running", 10.0, [])
    assert run_now("running", 10.0, 10.0, 5.0) == ("timed_out", 10.0, [("timed_out", 10.0)])
    assert run_now("queued", 10.0, 15.0, 5.0) == (None, 0.0, [("timed_out", 10.0)])
    assert run_now("failed", 10.0, 14.0, 5.0) == ("failed", 10.0, []) and run_now("failed", 10.0, 15.0, 5.0) == (None, 0.0, []) == run_now(None, 0.0, 15.0, 5.0)


def requests(spark, sf, **columns):
    rows = Q.timed(table(spark, sf, "events")).withColumns({k: F.expr(v) for k, v in columns.items()}).selectExpr("cast(user_id as string) key", "cast(ts as double) at", *columns).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append(r)
    return by_key


def test_leases_equal_the_plain_steps(spark, sf):
    want = []
    for key, rows in requests(spark, sf, worker=Q.WORKER, action=Q.ACTION).items():
        holder, until = None, 0.0
        for r in sorted(rows, key=lambda r: (r.at, r.worker, r.action)):
            holder, until, granted = lease_step(*lease_now(holder, until, r.at), r.worker, r.action, r.at, 86400.0)
            want.append((key, r.worker, r.action, r.at, granted, holder))
    got = [tuple(r) for r in Q.st6(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {g[4] for g in got} == {True, False}


@pytest.mark.parametrize("seconds", [172800.0])
def test_runs_equal_the_plain_steps(spark, sf, seconds):
    asked = requests(spark, sf, wanted=Q.WANTED)
    watermark = max(r.at for rows in asked.values() for r in rows) - 60
    want = []
    for key, rows in asked.items():
        status, end, path = None, 0.0, []
        for r in [*sorted(rows, key=lambda r: (r.at, r.wanted)), None]:
            if r is None and watermark < end:  # no timer has fired yet
                break
            status, end, late = run_now(status, end, watermark if r is None else r.at, seconds)
            moves = list(late)
            fresh = status is None
            if r is not None:
                after, accepted = run_step(status, r.wanted)
                if accepted:
                    moves.append((after, r.at))
                    end = end if status is not None else r.at + seconds
                    status = after
            for k, (after, at) in enumerate(moves):
                if fresh and k == len(late):
                    path = []
                want.append((key, path[-1] if path else None, after, at, ">".join([*path, after])))
                path.append(after)
            if fresh and not moves[len(late) :]:
                path = []
    got = [tuple(r) for r in Q.st7(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {g[2] for g in got} >= {"queued", "running", "timed_out"}


@pytest.mark.parametrize("name", ["leases", "runs"])
def test_keys_share_slots(spark, tmp_path, name):
    """Forty keys in two slots, over three batches: results by key, and state and timers by slot."""
    from datetime import datetime, timedelta

    from ledgerlake.streaming import processors as P

    start, seconds = datetime(2024, 1, 1), 500.0
    asks = [("acquire", "renew", "release"), ("queued", "running", "completed")][name == "runs"]
    rows = [(f"u{k * 7 % 40}", f"w{k // 3 % 2}", asks[k * k % 11 % 3], start + timedelta(seconds=10 * k)) for k in range(600)]
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "of string, worker string, what string, ts timestamp"
    for part in (rows[:250], rows[250:300], rows[300:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).parquet(log)
        with P.rocks_state(spark):
            made = P.leases(stream, "of", "worker", "what", "ts", seconds, slots=2) if name == "leases" else P.runs(stream, "of", "what", "ts", seconds, slots=2)
            run = made.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").option("path", out).trigger(availableNow=True).start()
            assert run.awaitTermination(180) and run.exception() is None
        held = run.lastProgress["stateOperators"][0]
        assert held["numRowsTotal"] <= 2 * 3  # a value and both sides of a timer
    zero, want = spark.createDataFrame(rows[:1], schema).selectExpr("cast(ts as double)").first()[0], []
    for key in sorted({r[0] for r in rows}):
        state, until, path = None, 0.0, []
        for k, (of, worker, what, _) in enumerate(rows):
            if of != key:
                continue
            at = zero + 10 * k
            if name == "leases":
                state, until, yes = lease_step(*lease_now(state, until, at), worker, what, at, seconds)
                want.append((key, worker, what, at, yes, state))
                continue
            state, until, moves = run_now(state, until, at, seconds)
            after, accepted = run_step(state, what)
            for move, when, begins in [*((m, w, False) for m, w in moves), *([(after, at, state is None)] if accepted else [])]:
                path = [] if begins else path
                want.append((key, path[-1] if path else None, move, when, ">".join([*path, move])))
                path.append(move)
            if accepted:
                state, until = after, until if state is not None else at + seconds
        if name == "runs" and state is not None and zero + 5990 - 60 >= until:
            want += [(key, path[-1], move, when, ">".join([*path, move])) for move, when in run_now(state, until, zero + 5990 - 60, seconds)[2]]
    assert sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str) == sorted(want, key=str)


def test_state_lies_in_few_partitions(spark):
    from ledgerlake.streaming.processors import PARTITIONS, rocks_state

    before = spark.conf.get(PARTITIONS)
    try:
        spark.conf.set(PARTITIONS, 200)
        with rocks_state(spark):
            assert int(spark.conf.get(PARTITIONS)) == max(16, 2 * spark.sparkContext.defaultParallelism)
        assert spark.conf.get(PARTITIONS) == "200"
    finally:
        spark.conf.set(PARTITIONS, before)

"""Keyed state machines over event streams: leases, runs, and events made of state changes.

Each is one stateful operator per key, whose state is a few values whatever the number of events; state lives in the
checkpoint, so a lost executor or a restart takes up where the stream stood. The decisions themselves are plain
functions, tested without a stream. Events of a key are taken by time within a batch; later batches follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# States of a run and the moves between them.
TERMINAL = ("completed", "failed", "cancelled", "timed_out")
MOVES = {"queued": ("running", "cancelled", "failed", "timed_out"), "running": ("queued", "cancelling", *TERMINAL), "cancelling": ("cancelled", "failed", "completed", "timed_out")}


def lease_step(holder: str | None, until: float, worker: str, action: str, at: float, seconds: float) -> tuple[str | None, float, bool]:
    """(holder, until, granted) after one request: acquire a free, ended or own lease, renew an own live one, release an own one."""
    live = holder is not None and at < until
    if action == "acquire" and (not live or holder == worker):
        return worker, at + seconds, True
    if action == "renew" and live and holder == worker:
        return worker, at + seconds, True
    if action == "release" and holder == worker:
        return None, 0.0, True
    return holder, until, False


def leases(stream: DataFrame, key: str, worker: str, action: str, time: str, seconds: float, delay: str = "1 minute") -> DataFrame:
    """(key, worker, action, at, granted, holder) of every request; a lease that has ended is forgotten by its timer."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        holder, until = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values(["_at", "_worker", "_action"], kind="stable")
        granted, holders = [], []
        for who, what, at in zip(rows["_worker"], rows["_action"], rows["_at"], strict=True):
            holder, until, yes = lease_step(holder, until, who, what, float(at), seconds)
            granted.append(yes)
            holders.append(holder)
        if holder is None:
            state.remove() if state.exists else None
        else:
            state.update((holder, until))
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(group[0])] * len(rows), "worker": rows["_worker"].to_numpy(), "action": rows["_action"].to_numpy(), "at": rows["_at"].to_numpy(), "granted": granted, "holder": holders})

    rows = stream.withWatermark(time, delay).select(F.col(key).cast("string").alias("_key"), F.col(worker).cast("string").alias("_worker"), F.col(action).alias("_action"), F.col(time).cast("double").alias("_at"), time)
    return rows.groupBy("_key").applyInPandasWithState(run, "key string, worker string, action string, at double, granted boolean, holder string", "holder string, until double", "append", "EventTimeTimeout")


def run_step(status: str | None, wanted: str) -> tuple[str, bool]:
    """(status, accepted): a run begins queued, moves as allowed, and never leaves a terminal state."""
    if status is None:
        return ("queued", True) if wanted == "queued" else ("", False)
    if wanted in MOVES.get(status, ()):
        return wanted, True
    return status, False


def run_states(stream: DataFrame, key: str, status: str, time: str, deadline_seconds: float, delay: str = "1 minute") -> DataFrame:
    """(key, before, after, at) of every accepted move of a run; one that isn't over by its deadline is timed out.

    A run's terminal state is kept for as long again as its deadline, so late requests are refused, and then forgotten.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, end = state.get if state.exists else (None, 0.0)
        out = []
        if state.hasTimedOut:
            if now in TERMINAL:
                state.remove()
                return
            out.append((str(group[0]), now, "timed_out", end))
            now = "timed_out"
        else:
            rows = pd.concat(list(batches)).sort_values("_at", kind="stable")
            for wanted, at in zip(rows["_status"], rows["_at"], strict=True):
                after, accepted = run_step(now, wanted)
                if accepted:
                    end = end or float(at) + deadline_seconds
                    out.append((str(group[0]), now, after, float(at)))
                    now = after
        if now:
            state.update((now, end))
            forget = end + deadline_seconds if now in TERMINAL else end
            state.setTimeoutTimestamp(max(int(forget * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "before", "after", "at"])

    rows = stream.withWatermark(time, delay).select(F.col(key).cast("string").alias("_key"), F.col(status).alias("_status"), F.col(time).cast("double").alias("_at"), time)
    return rows.groupBy("_key").applyInPandasWithState(run, "key string, before string, after string, at double", "status string, until double", "append", "EventTimeTimeout")


def changes(before: dict, after: dict) -> list[dict]:
    """One event for each field that two states of a run differ in, by name."""
    return [{"field": k, "before": before.get(k), "after": after.get(k)} for k in sorted({*before, *after}) if before.get(k) != after.get(k)]


def state_changes(stream: DataFrame, key: str, fields: tuple[str, ...], time: str) -> DataFrame:
    """(key, field, before, after, at): each state of a key compared with the one before, which is all that is kept."""
    kinds = ", ".join(f"{f} string" for f in fields)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = dict(zip(fields, state.get, strict=True)) if state.exists else {}
        out = []
        for _, row in pd.concat(list(batches)).sort_values("_at", kind="stable").iterrows():
            after = {f: None if pd.isna(row[f]) else row[f] for f in fields}
            out.extend((str(group[0]), c["field"], c["before"], c["after"], float(row["_at"])) for c in changes(now, after))
            now = after
        state.update(tuple(now[f] for f in fields))
        yield pd.DataFrame(out, columns=["key", "field", "before", "after", "at"])

    rows = stream.select(F.col(key).cast("string").alias("_key"), *[F.col(f).cast("string").alias(f) for f in fields], F.col(time).cast("double").alias("_at"))
    return rows.groupBy("_key").applyInPandasWithState(run, "key string, field string, before string, after string, at double", kinds, "append", "NoTimeout")

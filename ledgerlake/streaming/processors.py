"""Leases and runs as stateful processors: keys share slots, and a slot has a value in RocksDB and an event-time timer.

A slot holds the keys of one hash, so a micro-batch asks for state once a slot, however many keys it has; a call a key takes
milliseconds. The slots of a stream are fixed by its first batch; a slot's keys are read and written whole, so more keys than
some millions a slot want more slots.

What a request does depends on the state and on the request's own time alone: what should have happened before it (a lease
ended, a run passed its deadline or was forgotten) is caught up first, and for keys that get no further request the watermark
does the same, after the requests of a batch or by the slot's timer. So results don't depend on how events are cut into batches, as long as batches follow each other in
time; within a batch requests are sorted. State and timers lie in the checkpoint, so a stream that is started
again goes on where it stood. A null key, time or action makes no request.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlake.streaming.states import TERMINAL, lease_step, run_step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
LEASES = "key string, worker string, action string, at double, granted boolean, holder string"
RUNS = "key string, before string, after string, at double, path string"
SLOTS = 1024


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """State of streams that are started here lies in RocksDB, as these processors need, in partitions two a core at most.

    A partition is a task a micro-batch, which takes half a second or more to begin and to commit, however few keys it has.
    """
    before = {name: spark.conf.get(name) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(PARTITIONS, min(int(before[PARTITIONS]), max(16, 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def lease_now(holder: str | None, until: float, at: float) -> tuple[str | None, float]:
    """A lease that has ended is no one's."""
    return (holder, until) if holder is not None and at < until else (None, 0.0)


def run_now(status: str | None, end: float, at: float, seconds: float) -> tuple[str | None, float, list[tuple[str, float]]]:
    """(status, deadline, moves made) of a run by a time: timed out at its deadline, forgotten as long again after it."""
    moves = []
    if status is not None and status not in TERMINAL and at >= end:
        status, moves = "timed_out", [("timed_out", end)]
    if status is not None and at >= end + seconds:
        status, end = None, 0.0
    return status, end, moves


class _Slotted(StatefulProcessor):
    """The state of a slot's keys (by key: status, time, and so on), its only timer, and the requests of a batch in order."""

    #: Columns of the state beside the keys.
    STATE: dict[str, str]

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = {"keys": "string"} | self.STATE
        self.state = handle.getValueState("slot", ", ".join(f"{c} array<{kind}>" for c, kind in columns.items()))

    def close(self) -> None:
        pass

    def due(self, held: tuple) -> float:
        """When a key has something to do of itself."""
        raise NotImplementedError

    def passed(self, slot: dict[str, tuple], key: str, at: float) -> list[tuple]:
        """What comes of a key by a time that it is due: the slot is brought up to it."""
        raise NotImplementedError

    def read(self) -> tuple[dict[str, tuple], float | None]:
        """What the slot holds, and when the first of it is due."""
        held = self.state.get()
        slot = {} if held is None else {k: rest for k, *rest in zip(*held, strict=True)}
        return slot, min(map(self.due, slot.values()), default=None)

    def write(self, slot: dict[str, tuple], before: float | None, timerValues) -> list[tuple]:
        """The slot is kept, after all in it that the watermark has passed; what comes of that."""
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        for key in [k for k, held in slot.items() if self.due(held) * 1000 <= mark]:
            out += self.passed(slot, key, mark / 1000)
        if slot:
            self.state.update((list(slot), *map(list, zip(*slot.values(), strict=True))))
        elif before is not None:
            self.state.clear()
        self.wake(before, min(map(self.due, slot.values()), default=None))
        return out

    def wake(self, before: float | None, at: float | None) -> None:
        """The slot's only timer from now on, in place of the one that its state had; no call where they are the same."""
        old, new = (None if t is None else int(-(-t * 1000 // 1)) for t in (before, at))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    @staticmethod
    def ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
        return pd.concat(list(batches)).sort_values(by, kind="stable")


class Leases(_Slotted):
    STATE = {"holders": "string", "untils": "double"}

    def due(self, held: tuple) -> float:
        return held[1]

    def passed(self, slot: dict[str, tuple], key: str, at: float) -> list[tuple]:
        del slot[key]
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slot, before = self.read()
        own = self.ordered(rows, ["at", "worker", "action"])
        granted, holders = [], []
        for of, who, what, at in zip(own["of"], own["worker"], own["action"], own["at"].tolist(), strict=True):
            holder, until, yes = lease_step(*lease_now(*slot.get(of, (None, 0.0)), at), who, what, at, self.seconds)
            if holder is not None:
                slot[of] = holder, until
            else:
                slot.pop(of, None)
            granted.append(yes)
            holders.append(holder)
        self.write(slot, before, timerValues)
        yield pd.DataFrame({"key": own["of"].to_numpy(), "worker": own["worker"].to_numpy(), "action": own["action"].to_numpy(), "at": own["at"].to_numpy(), "granted": granted, "holder": holders})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.write(*self.read(), timerValues)
        return iter([])


class Runs(_Slotted):
    STATE = {"statuses": "string", "ends": "double", "paths": "string"}

    def due(self, held: tuple) -> float:
        """When a run in that state times out, or is forgotten."""
        status, end, _ = held
        return end + self.seconds if status in TERMINAL else end

    def passed(self, slot: dict[str, tuple], key: str, at: float) -> list[tuple]:
        return self.asked(slot, key, at, None)

    def asked(self, slot: dict[str, tuple], key: str, at: float, wanted: str | None) -> list[tuple]:
        """The moves that a request for a status (None: only the time) makes, each with the run's path so far."""
        status, end, path = slot.get(key, (None, 0.0, ""))
        status, end, moves = run_now(status, end, at, self.seconds)
        after, accepted = run_step(status, wanted) if wanted is not None else ("", False)
        out: list[tuple] = []
        for k, (move, when) in enumerate([*moves, (after, at)] if accepted else moves):
            if k == len(moves) and status is None:
                path = ""
            out.append((key, path.rpartition(">")[2] or None, move, when, path := f"{path}>{move}" if path else move))
        if accepted:
            status, end = after, end if status is not None else at + self.seconds
        if status is not None:
            slot[key] = status, end, path
        else:
            slot.pop(key, None)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slot, before = self.read()
        own = self.ordered(rows, ["at", "wanted"])
        out = [move for of, at, wanted in zip(own["of"], own["at"].tolist(), own["wanted"], strict=True) for move in self.asked(slot, of, at, wanted)]
        yield self.moves(out + self.write(slot, before, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.moves(self.write(*self.read(), timerValues))

    @staticmethod
    def moves(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "before", "after", "at", "path"])


def _slotted(rows: DataFrame, slots: int) -> GroupedData:
    """Rows by the slot of their key `of`."""
    return rows.withColumn("slot", F.pmod(F.xxhash64("of"), F.lit(slots)).cast("int")).groupBy("slot")


def leases(stream: DataFrame, key: str, worker: str, action: str, time: str, seconds: float, delay: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """(LEASES) of every request: acquire, renew or release."""
    rows = stream.withWatermark(time, delay).select(F.col(key).cast("string").alias("of"), F.col(worker).cast("string").alias("worker"), F.col(action).alias("action"), F.col(time).cast("double").alias("at"), time)
    asked = rows.filter(F.col("of").isNotNull() & F.col("at").isNotNull() & F.col("action").isNotNull())
    return _slotted(asked, slots).transformWithStateInPandas(Leases(seconds), LEASES, "Append", "EventTime")


def runs(stream: DataFrame, key: str, status: str, time: str, seconds: float, delay: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """(RUNS) of every accepted move of a run; one that isn't over `seconds` after it was queued is timed out then."""
    rows = stream.withWatermark(time, delay).select(F.col(key).cast("string").alias("of"), F.col(status).alias("wanted"), F.col(time).cast("double").alias("at"), time)
    asked = rows.filter(F.col("of").isNotNull() & F.col("at").isNotNull() & F.col("wanted").isNotNull())
    return _slotted(asked, slots).transformWithStateInPandas(Runs(seconds), RUNS, "Append", "EventTime")

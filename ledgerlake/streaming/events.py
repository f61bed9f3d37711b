"""Event logs: cursors, idempotent appends, tumbling rate limits, leases; batch forms and streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerlake.session import shared_folder


def page(log: DataFrame, ident: str, cursor: int, most: int = 100) -> DataFrame:
    """The next events after a cursor."""
    return log.filter(F.col(ident) > cursor).orderBy(ident).limit(most)


def event_stream(spark: SparkSession, folder: str, schema, name: str = "events.parquet") -> DataFrame:
    """A log's files as a stream; times without zone become timestamps, as watermarks need."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def append_once(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events whose key was not seen within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, key: str, time: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Tumbling windows: the first `limit` events of a key in each window are accepted."""
    start = F.floor(F.unix_timestamp(time) / seconds) * seconds
    own = W.partitionBy(key, "window_start").orderBy(time, order)
    return events.withColumn("window_start", start).withColumn("accepted", F.row_number().over(own) <= limit)


def rate_limit_stream(stream: DataFrame, key: str, time: str, seconds: int, limit: int) -> DataFrame:
    """(key, window_start, at, accepted) of every event: the first `limit` of a key and window by time are accepted; counts expire two windows after their start.

    A key is one group, whose state are the counts of its open windows. An event without a time makes no request.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = dict(zip(*state.get, strict=True)) if state.exists else {}
        if not state.hasTimedOut:
            # all that the micro-batch has of the key, by time
            rows = pd.concat(list(batches)).sort_values("_time", kind="stable").sort_values("_window", kind="stable")
            windows, starts, sizes = np.unique(rows["_window"].to_numpy(), return_index=True, return_counts=True)
            had = np.array([used.get(int(w), 0) for w in windows])
            place = np.arange(len(rows)) + np.repeat(had - starts, sizes)
            yield pd.DataFrame({"key": str(group[0]), "window_start": rows["_window"], "at": rows["_at"], "accepted": place < limit})
            used |= {int(w): int(n) for w, n in zip(windows, had + sizes, strict=True)}
        now = state.getCurrentWatermarkMs()
        used = {w: n for w, n in used.items() if (w + 2 * seconds) * 1000 > now}
        if used:
            state.update((list(used), list(used.values())))
            state.setTimeoutTimestamp((min(used) + 2 * seconds) * 1000)
        elif state.exists:
            state.remove()

    rows = stream.withWatermark(time, f"{seconds} seconds").select(F.col(key).cast("string").alias("_key"), (F.floor(F.unix_timestamp(time) / seconds) * seconds).alias("_window"), F.col(time).alias("_time"), F.col(time).cast("double").alias("_at"))
    return rows.filter("_window is not null").groupBy("_key").applyInPandasWithState(run, "key string, window_start long, at double, accepted boolean", "windows array<long>, used array<long>", "append", "EventTimeTimeout")


def claimable(runs: DataFrame, now) -> DataFrame:
    """Runs a worker may claim: queued, or running with a lease that has ended; oldest first."""
    return runs.filter((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < F.lit(now)))).orderBy("created_at", "run_id")


def expired_sessions(sessions: DataFrame, now, most: int) -> DataFrame:
    """Sessions past their end that hold no lease, oldest first."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < F.lit(now))
    return sessions.filter((F.col("expires_at") <= F.lit(now)) & free).orderBy("expires_at", "session_id").limit(most)


def transitions(states: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """One event for each change of state of a key."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(order))
    return states.withColumn("before", before).filter(~F.col(status).eqNullSafe(F.col("before")))


def followed(stream: DataFrame, path: str, over: Callable[[], bool], poll: float = 0.25, most: float = 600) -> DataFrame:
    """What a stream yields until its run is over and all is read, added to the table at `path`/rows; a later call goes on from there."""
    until = time.monotonic() + most
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(processingTime="0 seconds").start()
    try:
        while True:
            last = over()  # asked first: events may come until then
            run.processAllAvailable()
            if last:
                break
            if time.monotonic() > until:
                raise TimeoutError(f"the run wasn't over after {most} seconds")
            time.sleep(poll)
    finally:
        run.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def drained(stream: DataFrame, seconds: int = 600) -> DataFrame:
    """All that a stream yields of what is there now, written as a table with its checkpoint in the shared folder."""
    path = shared_folder(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").outputMode("append").trigger(availableNow=True).start()
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"the stream took over {seconds} seconds")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")

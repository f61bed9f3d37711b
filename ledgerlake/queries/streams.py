"""Queries over the event log as a stream, drained into a table, and over changes of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import query
from ledgerlake.session import shared_folder, table
from ledgerlake.sources.event_log import EventLog
from ledgerlake.streaming import events as E, late as L, processors as P, states as S


def log(spark, sf):
    return E.event_stream(spark, sf, table(spark, sf, "events").schema)


def twice(spark, sf, made, **options):
    """What `made` makes of the log by cursor: first as far as its middle, then to its end by a stream started anew."""
    spark.dataSource.register(EventLog)
    path, middle = shared_folder(spark), table(spark, sf, "events").agg(F.floor(F.avg("event_id"))).first()[0]
    pages = lambda **more: made(spark.readStream.format("event_log").options(ident="event_id", **options, **more).load(f"{sf}/events.parquet"))
    E.followed(pages(until=middle), path, lambda: True)
    return E.followed(pages(), path, lambda: True)


@query("st1_event_source", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id > 100")
def st1(spark, sf):
    """Pages of 100, across a restart."""
    return twice(spark, sf, lambda log: log, cursor=100).select("event_id", "ts", "user_id", "event_type", "value")


@query("st2_append_once", "SELECT DISTINCT user_id, event_type FROM events")
def st2(spark, sf):
    """The delay covers the whole log, so each key stays once."""
    return E.drained(E.append_once(log(spark, sf), ["user_id", "event_type"], delay="60 days").select("user_id", "event_type"))


@query("st4_rate_limit_stream", "WITH w AS (SELECT user_id, floor(epoch(ts))::BIGINT // 3600 * 3600 AS window_start, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS key, window_start, least(n, 2) AS accepted, greatest(n - 2, 0) AS rejected FROM w")
def st4(spark, sf):
    rows = E.drained(E.rate_limit_stream(log(spark, sf), "user_id", "ts", 3600, 2))
    return rows.groupBy("key", "window_start").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query("st5_st6_leases")
def st5(spark, sf):
    """Whether a request is granted depends on all before it, which SQL can't say; tests compare with the plain steps."""
    action = F.when(F.col("event_id") % 3 == 0, "release").when(F.col("event_id") % 3 == 1, "acquire").otherwise("renew")
    return E.drained(S.leases(log(spark, sf).withColumns({"action": action, "worker": F.col("event_id") % 2}), "user_id", "worker", "action", "ts", 86400.0))


@query("st8_transitions", "SELECT event_id, user_id, event_type AS after, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def st8(spark, sf):
    return E.transitions(table(spark, sf, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", F.col("event_type").alias("after"), "before")


@query("st8_state_changes", "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS after, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def st8_stream(spark, sf):
    return E.drained(S.state_changes(log(spark, sf), "user_id", ("event_type",), "ts")).select("key", "after", "before")


#: In the log's place of workers and actions, and of requested states.
WORKER, ACTION = "cast(event_id % 2 as string)", "CASE event_id % 3 WHEN 0 THEN 'release' WHEN 1 THEN 'acquire' ELSE 'renew' END"
WANTED = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancelling' WHEN 'error' THEN 'failed' ELSE 'completed' END"
timed = lambda log: log.withColumn("ts", F.col("ts").cast("timestamp"))


@query("st6_lease_processor")
def st6(spark, sf):
    """Leases of every user over the whole log, across a restart; tests compare with the plain steps."""
    with P.rocks_state(spark):
        return twice(spark, sf, lambda log: P.leases(timed(log).withColumns({"worker": F.expr(WORKER), "action": F.expr(ACTION)}), "user_id", "worker", "action", "ts", 86400.0))


@query("st7_run_processor")
def st7(spark, sf):
    """Runs of every user over the whole log, with a deadline of two days, across a restart; tests compare with the plain steps."""
    with P.rocks_state(spark):
        return twice(spark, sf, lambda log: P.runs(timed(log).withColumn("wanted", F.expr(WANTED)), "user_id", "wanted", "ts", 172800.0))


@query("st12_late_rows", """WITH e AS (SELECT event_type, CASE WHEN event_id % 9 = 4 THEN ts - INTERVAL 2 DAY ELSE ts END AS t, event_id // 1000 AS batch, event_id FROM events), m AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e GROUP BY batch)
SELECT date_trunc('day', t) AS window_start, event_type, count(*) AS n, count(*) FILTER (mark IS NOT NULL AND t < mark - INTERVAL 1 DAY) AS n_late FROM e JOIN m USING (batch) GROUP BY ALL""")
def st12(spark, sf):
    """The log in turns of a thousand, a ninth of it two days late: counts by day of what came in time and what didn't."""
    spark.dataSource.register(EventLog)
    log = spark.readStream.format("event_log").options(ident="event_id", cursor=-1).load(f"{sf}/events.parquet")
    moved = log.select("event_id", F.expr("event_id div 1000").alias("turn"), "event_type", F.when(F.col("event_id") % 9 == 4, F.col("ts") - F.expr("INTERVAL 2 DAY")).otherwise(F.col("ts")).cast("timestamp").alias("ts"))
    return L.corrected_counts(*L.kept_and_late(moved, shared_folder(spark), "ts", 86400.0, "turn"), "ts", "1 day", ["event_type"])

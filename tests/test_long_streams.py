"""Streams of many pages, turns and windows: few tasks and batches, and results that don't depend on where they are cut."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from ledgerlake.sources.event_log import SHARE, EventLogReader
from ledgerlake.streaming import events, late

START = datetime(2024, 1, 1)


def test_small_pages_share_partitions(tmp_path):
    pq.write_table(pa.table({"id": pa.array(range(3 * SHARE + 7), pa.int64())}), tmp_path / "log.parquet", row_group_size=SHARE)
    reader = EventLogReader({"path": str(tmp_path / "log.parquet"), "ident": "id", "cursor": "-1", "page": "100"}, None)
    end = reader.latestOffset()
    assert end == {"cursor": 3 * SHARE + 6}
    runs = reader.partitions({"cursor": -1}, end)
    assert [(r.low, r.high) for r in runs] == [(0, SHARE - 1), (SHARE, 2 * SHARE - 1), (2 * SHARE, 3 * SHARE - 1), (3 * SHARE, 3 * SHARE + 6)]


def test_late_rows_by_turn_wherever_batches_end(spark, tmp_path):
    seconds = [0, 50, 39, 41, 200, 41, 189, 191, 500, 191, None, 480]  # two rows a turn
    schema = "id long, turn long, ts timestamp"
    rows = [(k, k // 2, None if s is None else START + timedelta(seconds=s)) for k, s in enumerate(seconds)]
    marks = [max([s for s in seconds[: k // 2 * 2] if s is not None], default=None) for k in range(len(rows))]
    want = [k for k, s in enumerate(seconds) if s is None or marks[k] is not None and s < marks[k] - 10]
    for name, cuts in (("one", [0, 12]), ("some", [0, 3, 7, 8, 12])):
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
            kept, behind = late.kept_and_late(stream, str(tmp_path / f"{name}-out"), "ts", 10.0, "turn")
        assert sorted(r.id for r in behind.collect()) == want and sorted(r.id for r in kept.collect()) == [k for k in range(12) if k not in want]


def test_rate_limit_over_batches_and_windows(spark, tmp_path):
    """Counts of open windows go on in the next batch; an event without a time makes no request."""
    log = str(tmp_path / "log")
    for batch in ([(1, 0), (2, 5), (3, 70), (4, None)], [(5, 9), (6, 71), (7, 72), (8, 130)]):
        spark.createDataFrame([(k, "u", None if s is None else START + timedelta(seconds=s)) for k, s in batch], "id long, user string, ts timestamp").coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema("id long, user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(log)
    got = {(round(r.at - START.timestamp()), r.accepted) for r in events.drained(events.rate_limit_stream(stream, "user", "ts", 60, 2)).collect()}
    zone = min(s for s, _ in got)
    assert {(s - zone, yes) for s, yes in got} == {(0, True), (5, True), (9, False), (70, True), (71, True), (72, False), (130, True)}

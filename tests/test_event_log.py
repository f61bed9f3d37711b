"""The resumable event source: pages, growth between runs, gaps, odd ids."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from ledgerlake.sources.event_log import EventLog, EventLogReader, Stretch, ids_ahead, pages
from ledgerlake.sources.paths import opened
from ledgerlake.streaming.events import followed


def test_pages_hold_each_id_once():
    rng = random.Random(3)
    for _ in range(300):
        groups = [[rng.randrange(0, 400) * rng.choice([1, 10**9]) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(0, 8))]
        stretches = [Stretch(min(g), max(g), "f", k) for k, g in enumerate(groups)]
        after, page, end = rng.randrange(-5, 300), rng.randrange(1, 40), rng.choice([None, rng.randrange(0, 500)])
        read = lambda s: np.array(groups[s.group], np.int64)  # noqa: E731, B023
        ids = sorted(i for g in groups for i in g if i > after and (end is None or i <= end))
        assert ids_ahead(stretches, after, None, end, read).tolist() == ids
        at, got = after, []
        while some := pages(ids_ahead(stretches, at, 3 * page, end, read), page, 3):
            got += some
            at = some[-1][1]
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
        sizes = [[i for i in ids if low <= i <= high] for low, high in got]
        assert sum(sizes, []) == ids and all(len(x) - x.count(x[-1]) < page for x in sizes)


def write(path, name, ids):
    pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "kind": pa.array([f"k{i}" for i in ids])}), path / name, row_group_size=50)


def test_source_goes_on_where_it_stood(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    ids = [i for i in range(1, 400) if i % 7] + [9000, 10**12, 10**12]
    shuffled = random.Random(4).sample(ids, len(ids))
    write(log, "a.parquet", shuffled[:200])
    write(log, "b.parquet", [*shuffled[200:], None])
    (log / "_SUCCESS").write_bytes(b"")
    spark.dataSource.register(EventLog)
    stream = lambda **more: spark.readStream.format("event_log").options(ident="id", cursor=10, page=20, pages=3, **more).load(str(log))
    half = followed(stream(until=150), out, lambda: True)
    assert sorted(r.id for r in half.collect()) == sorted(i for i in ids if 10 < i <= 150)
    calls = iter([False, True])

    def over():
        last = next(calls)
        if last:  # events that come while the stream is followed
            write(log, "c.parquet", [10**12 + 1, 10**12 + 2])
        return last

    rows = followed(stream(), out, over).collect()
    assert sorted(r.id for r in rows) == sorted([*(i for i in ids if i > 10), 10**12 + 1, 10**12 + 2]) and all(r.kind == f"k{r.id}" for r in rows)
    assert followed(stream(), out, lambda: True).count() == len(rows)


def test_source_without_events(tmp_path):
    reader = EventLogReader({"path": f"file:{tmp_path}", "ident": "id", "cursor": "5"}, None)
    assert reader.latestOffset() == {"cursor": 5} and reader.partitions({"cursor": 5}, {"cursor": 5}) == []
    assert opened("file:///a/b")[1] == "/a/b"

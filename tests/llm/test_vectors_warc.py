"""Hard negatives, centroid clustering and WARC archives against plain Python."""

import gzip
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm.centroids import clustered, nearest, weighted_sums
from ledgerlake.llm.embeddings import near_duplicates
from ledgerlake.llm.negatives import hard_negatives
from ledgerlake.llm.vectors import products
from ledgerlake.llm.warc import END, archived, captures, parsed, records, write

BAD = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1e200, 1.0], [1e30, 0.0]]


def whole(v, scale):
    """Python's numbers, or None where the operators leave a vector out."""
    if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in v):
        return None
    out = [math.floor(x * scale) for x in v]
    return out if sum(x * x for x in out) < 2**60 else None


def brute_negatives(rows, every, positives=5, negatives=5):
    own = [(i, k, lab, q) for i, (k, lab, v) in enumerate(rows) if k is not None and lab is not None and (q := whole(v, 256)) is not None]
    out = []
    for i, k, lab, q in own:
        if k % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), kk, ll == lab) for j, kk, ll, p in own if j != i and len(p) == len(q))
        for s, kk, same in [x for x in scored if x[2]][:positives]:
            far = [(t, n) for t, n, alike in scored if not alike and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(k, kk, r + 1, n, -s, -t) for r, (t, n) in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [16_000_000, 3_000])
def test_hard_negatives_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 3)), (rng.integers(-3, 4, 6) / 256 + rng.integers(0, 3)).tolist()) for k in range(260)]
    rows += [(k, k % 2, [1.0, 2.0, 0.5, 0.25, 0.0, 1.0]) for k in range(300, 420)]  # a hot vector, with ties by id
    rows += [(k, 1, [float(k % 5), 2.0]) for k in range(420, 440)]  # another length
    rows += [(440 + k, k % 2, (rng.normal(size=3) * 1e5).tolist()) for k in range(30)]  # beyond exact doubles
    rows += [(20, 2, rows[20][2]), (20, 1, rows[3][2]), (None, 1, rows[0][2]), (500, None, rows[0][2])]
    rows += [(600 + k, 1, v) for k, v in enumerate(BAD)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("slot", F.lit("clash")).withColumn("q", F.lit(1))
    got = sorted(tuple(r) for r in hard_negatives(df.repartition(5), F.col("vec_id") % 20 == 0, block_bytes=block_bytes).collect())
    assert got == brute_negatives(rows, 20) and len(got) > 100
    assert hard_negatives(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_products_are_exact():
    a = np.array([[2**29 - 1, 3], [2**29, -1]])
    assert products(a, a).astype(object).tolist() == [[(2**29 - 1) ** 2 + 9, (2**29 - 1) * 2**29 - 3], [(2**29 - 1) * 2**29 - 3, 2**58 + 1]]
    assert weighted_sums(np.array([[2**30, -1]]), np.array([2**40])) == [2**70, -(2**40)]
    assert nearest(np.array([[1, 1], [5, 5]]), np.array([[0, 0], [2, 2], [2, 2]]))[0].tolist() == [0, 1]


def brute_clusters(rows, size, k, rounds):
    own = [(i, q) for i, v in rows if v is not None and len(v) == size and (q := whole(v, 1024)) is not None]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in own if i is not None)[:k]
    centroids = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in own:
            groups.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    last = [(i, *near(q)) for i, q in own]
    return sorted(((i, c, d, sum(x for _, x, cc in last if cc == c), sum(x for _, x, _ in last), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in last), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=4) + 3 * (k % 3)).tolist()) for k in range(150)]
    rows += [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(200, 300)] + [(None, [2.0] * 4), (7, [3.0] * 4), (7, [3.0] * 4), (8, [1e5] * 4)]
    rows += [(400 + k, None if v is None else (v * 4)[:4]) for k, v in enumerate(BAD)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((tuple(r) for r in clustered(df.repartition(3), size=4, clusters=5, rounds=4).collect()), key=str)
    assert got == brute_clusters(rows, 4, 5, 4)
    few = clustered(df.filter("vec_id in (0, 1)"), size=4)
    assert sorted((r.vec_id, r.distance) for r in few.collect()) == [(0, 0), (1, 0)]
    assert clustered(df.filter("false"), size=4).count() == clustered(df.filter("vec_id is null"), size=4).count() == 0


PAGES = [
    (1, "http://a.example/x", "short"), (2, "http://a.example/y", "short"), (3, None, "L" * 1000), (9, "http://b.example/?q=1", "L" * 1000), (5, "bad uri\r\nX: y", "L" * 1000), (None, "http://c.example/", "L" * 1000),
    (6, "http://d.example/é", None), (7, "", ""), (8, "http://e.example/", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40), (10, "http://f.example/", "é" * 60_000),
    (11, "http://g.example/", "T" * 2000), (11, "http://g.example/", "T" * 2000), (4, "http://g.example/", "T" * 2000), (12, "http://h.example/", "short"), (12, "http://h.example/", "short"), (None, None, "N" * 1500), (None, None, "N" * 1500),
]


def brute_pages(rows):
    first = {}
    for k, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000:
            first[h] = max((x for x in (first.get(h), k) if x is not None), default=None)
    out = []
    for k, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= 1000 and first[h] != k
        out.append((k, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def test_archives_read_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("value", F.lit("clash")).withColumn("_id", F.lit(0))
    assert sorted((tuple(r) for r in archived(df.repartition(3)).collect()), key=str) == brute_pages(PAGES)
    assert archived(df.filter("false")).count() == 0


def test_archives_hold_whole_transactions(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    write(df, str(tmp_path / "a"), file_bytes=20_000)
    found = records(spark, str(tmp_path / "a"), payloads=True).cache()
    assert len(list((tmp_path / "a").glob("part-*.gz"))) > 1
    assert found.count() == 3 * len(PAGES) and found.select("record_id").distinct().count() == 3 * len(PAGES)
    rows = captures(found).collect()
    assert len(rows) == len(PAGES) and all(len(r.requests) == len(r.metadata) == 1 and r.requests[0].concurrent == [r.capture.record_id] for r in rows)
    want = {k: (h or "").encode() for k, _, h in PAGES if k in (1, 6, 8, 10)}
    assert {k: bytes(r.capture.payload) for r in rows if (k := int(dict(r.metadata[0].fields).get("page-id", -1))) in want} == want
    assert {r.capture.target for r in rows if r.capture.type == "revisit"} == {"urn:none", "bad%20uri%20%20X:%20y", "http://c.example/", "http://g.example/"}


def record(kind, ident, block, *more, content="application/http; msgtype=x"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"Content-Type: {content}", f"content-length: {len(block)}", *more]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + END).encode() + block + END.encode()


def test_archives_of_others(spark, tmp_path):
    """Gzip members, plain files, links in either direction and over a request, what is cut off, what no one names."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    one = [record("warcinfo", "w", b"x: y", content="application/warc-fields"), record("response", "r1", http, "WARC-Concurrent-To: q1"), record("request", "q1", b"GET / HTTP/1.1\r\n\r\n")]
    two = [record("metadata", "m1", b"k: v\nother: 1", "WARC-Concurrent-To: q1", content="application/warc-fields"), record("resource", "r2", b"plain", content="text/plain"), record("metadata", "m2", b"", "WARC-Concurrent-To: gone")]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "two.warc").write_bytes(b"noise\r\n" + b"".join(two) + record("response", "r3", http)[:-10] + b"")
    rows = {r.capture.record_id: r for r in captures(records(spark, str(tmp_path), payloads=True)).collect()}
    assert set(rows) == {"r1", "r2"}
    assert [x.record_id for x in rows["r1"].requests] == ["q1"] and [x.fields for x in rows["r1"].metadata] == [{"k": "v", "other": "1"}]
    assert bytes(rows["r1"].capture.payload) == b"body" and rows["r1"].capture.sha1 == hashlib.sha1(b"body").hexdigest()
    assert bytes(rows["r2"].capture.payload) == b"plain" and not rows["r2"].requests and not rows["r2"].metadata
    assert [r["record_id"] for r in parsed(gzip.compress(b"".join(one))[:-3], False)] == ["w", "r1", "q1"] and list(parsed(b"", True)) == []


def test_near_duplicates_of_many_lengths(spark):
    """Vectors of 25 lengths go through the same jobs, and only those of one length are linked."""
    rng = np.random.default_rng(16)
    rows, want = [], {}
    for k in range(25):
        base = rng.normal(size=k + 2)
        for j in range(4):
            rows.append((10 * k + j, (base + 1e-3 * rng.normal(size=k + 2)).tolist()))
            want[10 * k + j] = (3, 10 * k)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(frame, run_rows=3).collect()}
    assert got == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(before) < 100

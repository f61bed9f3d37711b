"""SimHash near-duplicates by anchor points of a covering code.

Two fingerprints that differ in at most three bits differ in at most one bit of one half. The anchors of a half are the
words of the Hamming code of length 31 (its last bit is left aside), whose covering radius is 1: every half has an
anchor within one bit, and its partners, one bit further, have that anchor within two. So each distinct fingerprint
goes to all anchors within two bits of each half, at most sixteen a half, and only fingerprints of one anchor are
compared. Many anchors share one task; within it each anchor's links are reduced to a spanning star, so a large group
of near copies costs a row a member. An anchor that holds more than `hot` fingerprints is dealt again by anchors of
the Hamming code of length 15 in the two quarters of the other half, one of which differs in at most one bit.

Null or empty text: fingerprint zero, linked like any other. Copies have one fingerprint and are compared once; rows
that repeat a doc_id with another text are rows of their own. A null doc_id is linked and passes links on, but names no
component: a group without any doc_id has the component null. A text of any length is read whole; its words are hashed
in runs of bounded size. An empty table gives no rows. Columns besides doc_id, the text and `keep` are ignored.

near_copies, for texts alike by five-word shingles, uses the same anchors on 192 bits over words and word pairs to draw
families together, and checks the near pairs within each. The same holds there, but for copies: equal texts, by a 64-bit hash, are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlake.llm.shared import connected_components, discard, local_components, slices, stored, texts


def fingerprints_of(batch: list[str], size: int = 3, seed: int = 42, block: int = 100_000, bits: int = 64) -> np.ndarray:
    """The fingerprints of some texts, of 64 bits, or of 128 in two columns; shingles are hashed and added up in runs of about `block`."""
    from xxhash import xxh3_128_digest, xxh64_digest

    digest = {64: xxh64_digest, 128: xxh3_128_digest}[bits]  # big-endian bytes
    ones = np.zeros((len(batch), bits), np.int64)
    counts = np.zeros(len(batch), np.int64)
    hashes: list[bytes] = []
    owner: list[tuple[int, int]] = []

    def add() -> None:
        each = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, bits // 8)[:, ::-1]
        bits_of = np.unpackbits(each, axis=1, bitorder="little")
        which, n = np.array(owner, np.int64).T
        np.add.at(ones, which, np.add.reduceat(bits_of, np.cumsum(n) - n, axis=0, dtype=np.int64))
        hashes.clear()
        owner.clear()

    for k, text in enumerate(batch):
        words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space cuts
        counts[k] = max(1, len(words) - size + 1) if words else 0
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        begins, stops = ends - lengths, ends[min(size, len(words)) - 1 :] - 1 if words else ends
        for i in range(0, int(counts[k]), block):
            own = [digest(joined[a:b], seed) for a, b in zip(begins[i : i + block].tolist(), stops[i : i + block].tolist(), strict=False)]
            hashes.extend(own)
            owner.append((k, len(own)))
            if len(hashes) >= block:
                add()
    if hashes:
        add()
    found = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64)
    return found.ravel() if bits == 64 else found


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep columns, fp): fp has the fingerprint's bits as a signed number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*rows.drop("_text").schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                own = pa.array(fingerprints_of(texts(part, "_text")).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], own], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _masks(length: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming code of this length: what to flip to reach every code word within two bits."""
    out = [np.zeros(1, np.uint64)]
    for s in range(1, length + 1):
        pairs = [1 << (i - 1) | 1 << (j - 1) for i in range(1, length + 1) if i < (j := i ^ s) <= length]
        out.append(np.array([1 << (s - 1), *pairs], np.uint64))
    return out


def anchors(values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which value, anchor) for every code word within two bits of the low `length` bits of each value."""
    masks = _masks(length)
    values = values & np.uint64((1 << length) - 1)
    syndrome = np.zeros(len(values), np.int64)
    for i in range(1, length + 1):
        syndrome ^= np.where(values >> np.uint64(i - 1) & np.uint64(1), i, 0)
    which, out = [], []
    for s, flips in enumerate(masks):
        own = np.flatnonzero(syndrome == s)
        which.append(np.repeat(own, len(flips)))
        out.append((values[own][:, None] ^ flips[None, :]).ravel())
    return np.concatenate(which), np.concatenate(out)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, anchor key) over both halves."""
    found = [anchors(fps >> np.uint64(32 * half), 31) for half in (0, 1)]
    return np.concatenate([w for w, _ in found]), np.concatenate([a | np.uint64(half) << np.uint64(32) for half, (_, a) in enumerate(found)])


def finer_keys(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of anchors that hold too many: their keys with anchors of the other half's two quarters added."""
    other = fps >> np.where(keys >> np.uint64(32) & np.uint64(1), np.uint64(0), np.uint64(32))
    which, out = [], []
    for quarter in (0, 1):
        own, anchor = anchors(other >> np.uint64(16 * quarter), 15)
        which.append(own)
        out.append(keys[own] | np.uint64(1) << np.uint64(33) | np.uint64(quarter) << np.uint64(34) | anchor << np.uint64(35))
    return np.concatenate(which), np.concatenate(out)


def links_within(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (as positions) between rows of one key at most `distance` bits apart; fps has a word a row, or a row of words."""
    fps = fps.reshape(len(fps), -1)
    order = np.lexsort((fps[:, 0], keys))
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    near = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int16) <= distance
    left, right = [], []
    rows = np.flatnonzero(np.repeat((sizes <= 64) & (sizes > 1), sizes))
    for d in range(1, int(sizes[(sizes <= 64)].max(initial=1))):
        a = rows[rows + d < len(keys)]
        a = a[keys[a] == keys[a + d]]
        if not len(a):
            break
        a = a[near(fps[a], fps[a + d])]
        left.append(a)
        right.append(a + d)
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own = fps[start : start + size]
        label = np.arange(size)
        for i in range(0, size, 1024):
            for j in range(i, size, 1024):
                if label[i : i + 1024].min() == label[i : i + 1024].max() == label[j : j + 1024].min() == label[j : j + 1024].max():
                    continue  # all of them are linked already
                a, b = np.nonzero(near(own[i : i + 1024, None], own[None, j : j + 1024]))
                label = local_components(size, np.concatenate([np.arange(size), a + i]), np.concatenate([label, b + j]))
        far = np.flatnonzero(label != np.arange(size))
        left.append(start + label[far])
        right.append(start + far)
    none = np.zeros(0, np.int64)
    return order[np.concatenate(left)] if left else none, order[np.concatenate(right)] if right else none


def _unsigned(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def _keyed(fps: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(keys.view(np.int64))], names=["fp", "key"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 20_000):
            fps = _unsigned(batch.column(0).slice(k, 20_000))
            which, keys = keys_of(fps)
            yield _keyed(fps[which], keys)


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 20_000):
            fps, keys = (_unsigned(batch.column(i).slice(k, 20_000)) for i in (0, 1))
            which, finer = finer_keys(fps, keys)
            yield _keyed(fps[which], finer)


def near_links(fingerprints: DataFrame, distance: int = 3, hot: int = 30_000, bucket_rows: int = 500_000) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (column fp) at most three bits apart, enough to connect all that are.

    Anchors are counted, added up before they move, and only those of at most `hot` fingerprints are gathered. The
    others are dealt again by finer anchors and counted again; what is still too large is dealt by hash into blocks of
    about `hot` / 2, and every two blocks meet in a group of their own.
    """
    if distance > 3:
        raise ValueError("two halves with one bit each cover three differing bits at most")
    spark = fingerprints.sparkSession

    def compare(table: pa.Table) -> pa.Table:
        fps, keys = (_unsigned(table.column(c)) for c in ("fp", "key"))
        a, b = links_within(keys, fps, distance)
        # one star a component of this task's links
        ids, inverse = np.unique(np.concatenate([fps[a], fps[b]]).view(np.int64), return_inverse=True)
        label = local_components(len(ids), inverse[: len(a)], inverse[len(a) :])
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"src": ids[label[far]], "dst": ids[far]})

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(rows: DataFrame, expected: int) -> DataFrame:
        buckets = max(least, expected // bucket_rows + 1)
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        return dealt.groupBy("bucket").applyInArrow(compare, "src long, dst long")

    rows = fingerprints.select("fp").mapInArrow(_spread, "fp long, key long")
    parts = []
    for finer in (True, False):
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        crowded = stored(counts.filter(F.col("n") > hot).select(F.col("key").alias("_key"), "n"), "crowded")
        same = F.col("key") == F.col("_key")
        expected = counts.agg(F.sum("n")).first()[0] or 0
        if crowded.isEmpty():
            return _together([*parts, compared(rows, expected)])
        parts.append(compared(rows.join(crowded, same, "left_anti"), expected))
        rows = rows.join(crowded, same).select("fp", "key", "n")
        if finer:
            rows = rows.select("fp", "key").mapInArrow(_deal_again, "fp long, key long")
    blocks = F.ceil(F.col("n") * 2 / hot).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    meeting = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    paired = meeting.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    return _together([*parts, compared(paired, paired.count())])


#: The columns of a signature: 64 bits over single words, and 128 over word pairs.
PARTS = ("a", "b", "c")


def with_signatures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep columns, node, a, b, c): node names the text, the others hold its signature."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.xxhash64(text).alias("node"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*rows.drop("_text").schema.fields, *[T.StructField(c, T.LongType()) for c in PARTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                own = texts(part, "_text")
                words = [fingerprints_of(own, 1)[:, None], fingerprints_of(own, 2, bits=128)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, np.hstack(words).view(np.int64).T)], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _spread_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 10_000):
            part = batch.slice(k, 10_000)
            for word, column in enumerate(PARTS):
                which, keys = keys_of(_unsigned(part.column(column)))
                rows = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((keys | np.uint64(word) << np.uint64(33)).view(np.int64))], names=["node", *PARTS, "key"])


def family_links(nodes: DataFrame, distance: int = 30, hot: int = 30_000, bucket_rows: int = 500_000) -> DataFrame:
    """Links (src, dst) of nodes (node, a, b, c) that connect all that share an anchor and differ in at most `distance` of 192 bits.

    Two signatures with at most two differing bits in any of the six halves share an anchor. Each task sends a star for
    each group it connects, never its pairs. An anchor of more than `hot` rows is dealt by hash into blocks of about
    `hot` / 2, and every two blocks meet.
    """
    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(table: pa.Table) -> pa.Table:
        fps, node = np.stack([_unsigned(table.column(c)) for c in PARTS], axis=1), np.asarray(table.column("node"))
        a, b = links_within(_unsigned(table.column("key")), fps, distance)
        ids, inverse = np.unique(np.concatenate([node[a], node[b]]), return_inverse=True)
        label = local_components(len(ids), inverse[: len(a)], inverse[len(a) :])
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"src": ids[label[far]], "dst": ids[far]})

    def compared(rows: DataFrame, expected: int) -> DataFrame:
        buckets = max(least, expected // bucket_rows + 1)
        dealt = rows.select("node", *PARTS, "key", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        return dealt.groupBy("bucket").applyInArrow(compare, "src long, dst long")

    rows = nodes.select("node", *PARTS).mapInArrow(_spread_wide, "node long, a long, b long, c long, key long")
    expected = nodes.count() * 96
    # cells of many anchors are counted first: only where one holds too much can an anchor do so
    cell = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(expected * 10 // hot + 1))
    heavy = stored(rows.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("_cell"), "heavy")
    if heavy.isEmpty():
        return compared(rows, expected)
    counts = rows.join(heavy, cell == F.col("_cell"), "left_semi").groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(counts.filter(F.col("n") > hot), "crowded")
    if crowded.isEmpty():
        return compared(rows, expected)
    same = F.col("key") == F.col("_key")
    blocks = F.ceil(F.col("n") * 2 / hot).cast("long")
    own = F.pmod(F.xxhash64("node"), blocks)
    meeting = rows.join(crowded, same).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    paired = stored(meeting.select("node", *PARTS, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")), "blocks")
    return _together([compared(rows.join(crowded, same, "left_anti"), expected), compared(paired, paired.count())])


def alike_within(fps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, distance: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (as positions) of rows whose signatures are near and whose sets are alike; between rows of the two sides where both occur.

    Near pairs are taken by distance, and one whose rows are connected by then is left out. Sets are compared by bits,
    one for each element that several rows hold.
    """
    n = len(sets)
    crossed = bool(sides.any()) and not sides.all()
    left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if crossed else [np.arange(n)] * 2
    sizes = np.fromiter(map(len, sets), np.int64, n)
    found = []
    for i in range(0, len(left), 512):
        for j in range(0, len(right), 512):
            x, y = left[i : i + 512], right[j : j + 512]
            apart = np.bitwise_count(fps[x, None] ^ fps[None, y]).sum(-1, dtype=np.int16)
            big, small = np.maximum(sizes[x, None], sizes[None, y]), np.minimum(sizes[x, None], sizes[None, y])
            a, b = np.nonzero((apart <= distance) & (small >= similarity * big) & ((x[:, None] < y[None]) | crossed))
            found.append(np.stack([apart[a, b], x[a], y[b]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    _, a, b = pairs[:, np.argsort(pairs[0], kind="stable")].astype(np.int64)
    values, inverse, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *sets]), return_inverse=True, return_counts=True)
    code = np.cumsum(counts > 1) - 1
    bits = np.zeros((n, (int((counts > 1).sum()) + 63) // 64), np.uint64)
    row = np.repeat(np.arange(n), sizes)
    kept = counts[inverse] > 1
    at = code[inverse[kept]]
    np.bitwise_or.at(bits, (row[kept], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    label = np.arange(n)
    step = max(16, 500_000 // max(1, bits.shape[1]))
    out = []
    for k in range(0, len(a), step):
        x, y = a[k : k + step], b[k : k + step]
        open_yet = label[x] != label[y]
        x, y = x[open_yet], y[open_yet]
        shared = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
        yes = shared >= similarity * (sizes[x] + sizes[y] - shared)
        if yes.any():
            out.append((x[yes], y[yes]))
            label = local_components(n, np.concatenate([np.arange(n), x[yes]]), np.concatenate([label, y[yes]]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (none, none)


def alike_links(members: DataFrame, distance: int, similarity: float, block_bytes: int = 4_000_000, bucket_bytes: int = 16_000_000) -> DataFrame:
    """Links (src, dst) that connect all alike members (family, node, a, b, c, shingles) of each family.

    A family of more than `block_bytes` is dealt by hash into blocks, and every two blocks meet; a member goes to as many
    tasks as its family has blocks, and no task emits more than a spanning link a row.
    """
    spark = members.sparkSession
    weight = F.size("shingles") * 4 + 64
    families = stored(members.groupBy(F.col("family").alias("_f")).agg(F.sum(weight).alias("bytes")).withColumn("blocks", F.ceil(F.col("bytes") / block_bytes).cast("long")), "families")
    total = families.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes + 1)
    dealt = members.join(families, F.col("family") == F.col("_f")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    meet = F.xxhash64("family", low, high)
    # the side is 0 for all rows where a block meets itself
    sent = dealt.select("node", *PARTS, "shingles", meet.alias("meet"), F.when((low < high) & (F.col("own") == high), 1).otherwise(0).alias("side"), (low < high).alias("two"), F.pmod(meet, F.lit(buckets)).alias("bucket"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("meet")
        meets = np.asarray(table.column("meet"))
        cuts = np.flatnonzero(np.concatenate([[True], meets[1:] != meets[:-1], [True]]))
        fps, node, side = np.stack([_unsigned(table.column(c)) for c in PARTS], axis=1), np.asarray(table.column("node")), np.asarray(table.column("side"))
        two = table.column("two").to_pylist()
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = side[start:stop]
            if two[start] and own.min() == own.max():
                continue  # the other block is empty
            sets = [np.asarray(x.values, np.int32) for x in table.column("shingles").slice(start, stop - start)]
            a, b = alike_within(fps[start:stop], sets, own, distance, similarity)
            src.append(node[start + a])
            dst.append(node[start + b])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return sent.groupBy("bucket").applyInArrow(compare, "src long, dst long")


def shingle_sets(rows: DataFrame, size: int, block: int = 100_000) -> DataFrame:
    """(node, shingles) of rows (node, text): distinct 32-bit hashes of runs of `size` words; a shorter text is one run."""
    from xxhash import xxh32_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = []
                for text in texts(part, "text"):
                    words = text.encode().lower().split()
                    n = max(1, len(words) - size + 1) if words else 0
                    runs = [np.fromiter((xxh32_intdigest(b" ".join(words[k : k + size])) for k in range(i, min(i + block, n))), np.uint32) for i in range(0, n, block)]
                    sets.append(np.unique(np.concatenate([np.zeros(0, np.uint32), *runs])).view(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<int>")


def near_copies(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, keep columns, node, root, component_id) of every row; root names a group of texts linked as near copies.

    Texts are linked where their sets of `size`-word shingles have a Jaccard similarity of at least `similarity` and
    their signatures differ in at most 30 of 192 bits. Anchors of a SimHash over words and word pairs, which changes less
    with a changed word than one over longer shingles would, draw texts together into families; within a family all near
    pairs are checked, unless their texts are connected by then, with whole sets of 32-bit hashes. Equal texts are one
    node. Texts without a word are linked.
    """
    marked = stored(with_signatures(docs, text, keep), "signatures")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in PARTS]), "nodes")
    links = stored(family_links(nodes).dropDuplicates(), "links")
    families = stored(connected_components(links).select(F.col("node").alias("_end"), F.col("component").alias("family")), "families")
    own = docs.select(F.xxhash64(text).alias("node"), F.col(text).cast("string").alias("text")).join(families, F.col("node") == F.col("_end"), "left_semi")
    sets = shingle_sets(own, size).groupBy("node").agg(F.first("shingles").alias("shingles"))
    members = stored(sets.join(families, F.col("node") == F.col("_end")).drop("_end").join(nodes.select(F.col("node").alias("_n"), *PARTS), F.col("node") == F.col("_n")).drop("_n"), "members")
    alike = alike_links(members, 30, similarity)
    kept = stored(alike, "alike")
    discard(links, families, members)
    found = connected_components(kept).select(F.col("node").alias("_n"), "component")
    rooted = nodes.join(found, F.col("node") == F.col("_n"), "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    names = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    named = rooted.join(names, F.col("root") == F.col("_r")).select(F.col("node").alias("_node"), "root", "component_id")
    return marked.join(named, F.col("node") == F.col("_node")).select("doc_id", *keep, "node", "root", "component_id")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def components(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep columns, fp, root, component_id) of every row; root: a fingerprint that names the group."""
    marked = stored(with_fingerprints(docs, text, keep), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected_components(near_links(nodes)).select(F.col("node").alias("_n"), "component")
    rooted = nodes.join(found, F.col("fp") == F.col("_n"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    named = rooted.join(names, F.col("root") == F.col("_r")).select(F.col("fp").alias("_fp"), "root", "component_id")
    return marked.join(named, F.col("fp") == F.col("_fp")).select("doc_id", *keep, "fp", "root", "component_id")

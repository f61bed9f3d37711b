"""What the operators share: the shared folder, batches of bounded size, tokens, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A run of bytes that are no ASCII white space; bytes.split() cuts at the same bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that one step in Python handles at a time.
SLICE_BYTES = 500_000
#: Words or bytes that one step of hashing handles at a time; the tables of powers are as long.
BLOCK = 250_000


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or on one machine (tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlake-"))
    return context.getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads; what has been made of them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; one longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


#: Two primes below 2**31 and a base for each: a hash has 62 bits. The third deals hashes into buckets on its own bits.
PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013))
DEALING = (2_147_483_587, 22_695_477)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(k: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the k-th prime, or their inverses; tables of up to BLOCK are kept."""
    prime, base = (*PRIMES, DEALING)[k]
    base = pow(base, -1, prime) if inverse else base
    have = _powers.get((k, inverse), np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, have * pow(base, len(have), prime) % prime])
    _powers[k, inverse] = have[: BLOCK + 1].copy() if len(have) > BLOCK + 1 else have
    return have[:n]


def byte_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, which: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
    """Rabin-Karp remainders of the byte runs [begin, end) of raw, which must ascend and not overlap, by each prime asked for.

    Prefix sums restart every BLOCK bytes or so, at the end of a run, so that no table grows with the input.
    """
    out = [np.zeros(len(begins), np.int64) for _ in which]
    k = 0
    while k < len(begins):  # an empty run may begin where the bytes end
        first = int(begins[k])
        stop = max(k + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        part = raw[first : int(ends[stop - 1])].astype(np.int64) + 1
        a, b = begins[k:stop] - first, ends[k:stop] - first
        for into, prime_at in zip(out, which, strict=True):
            prime = (*PRIMES, DEALING)[prime_at][0]
            total = np.concatenate([[0], np.cumsum(part * powers(prime_at, len(part)))])
            into[k:stop] = (total[b] - total[a]) % prime * powers(prime_at, len(part) + 1, inverse=True)[a] % prime
        k = stop
    return out


def window_hashes(documents: list[list[bytes]], size: int, block: int = BLOCK, dealt: bool = False) -> tuple[np.ndarray, ...]:
    """Rabin-Karp hashes of every run of `size` words of each list, in order, and how many each list has.

    With `dealt` a third array has each window's remainder by the dealing prime. A window's hash is that of its bytes with one space between words, taken from prefix sums modulo two primes. A
    list whose words have over `block` bytes is cut into runs that overlap by size - 1 words, so memory stays bounded.
    """
    runs: list[tuple[bytes, int]] = []
    for words in documents:
        if len(words) < size:
            continue
        step = max(size, len(words) * block // (sum(map(len, words)) + len(words)))
        for a in range(0, len(words) - size + 1, step):
            own = words[a : a + step + size - 1]
            runs.append((b" ".join(own), len(own)))
    out: list[np.ndarray] = []
    deal: list[np.ndarray] = []
    k = 0
    while k < len(runs):
        stop, n = k, 0
        while stop < len(runs) and (stop == k or n + len(runs[stop][0]) < block):
            n += len(runs[stop][0]) + 1
            stop += 1
        raw = np.frombuffer(b" ".join(r[0] for r in runs[k:stop]) + b" ", np.uint8)
        ends = np.flatnonzero(raw == 32)
        begins = np.concatenate([[0], ends[:-1] + 1])
        counts = np.array([r[1] for r in runs[k:stop]], np.int64)
        firsts = np.cumsum(counts) - counts
        have = counts - size + 1
        start = np.repeat(firsts - np.cumsum(have) + have, have) + np.arange(have.sum())
        s, e = begins[start], ends[start + size - 1]
        halves = []
        for which, (prime, _) in enumerate((*PRIMES, DEALING) if dealt else PRIMES):
            total = np.concatenate([[0], np.cumsum((raw.astype(np.int64) + 1) * powers(which, len(raw)))])
            halves.append((total[e] - total[s]) % prime * powers(which, len(raw), inverse=True)[s] % prime)
        deal.extend(x.astype(np.uint32) for x in halves[2:])
        out.append(halves[0].astype(np.uint64) << np.uint64(31) | halves[1].astype(np.uint64))
        k = stop
    counts = np.array([max(0, len(words) - size + 1) for words in documents], np.int64)
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    if not dealt:
        return hashes, counts
    return hashes, counts, np.concatenate(deal) if deal else np.zeros(0, np.uint32)


def with_chunks(docs: DataFrame, text: str = "text", chunk_bytes: int = 2_500_000) -> tuple[DataFrame, int, int]:
    """The rows with a column chunk, dealt by hash into chunks of about `chunk_bytes` of text; chunks; bytes in all.

    The hash takes in the number of the partition a row comes from, so a row that is repeated all over the input is
    dealt over many chunks, and a partition that is read again deals its rows as before.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, round(total / chunk_bytes))
    return docs.withColumn("chunk", F.pmod(F.xxhash64(F.spark_partition_id(), *[c for c, kind in docs.dtypes if not kind.startswith("map")]), F.lit(chunks))), chunks, total


@dataclass(frozen=True)
class Deal:
    """How 64-bit keys of many chunks meet: in `slots` * `finer` buckets, by their 31-bit dealing numbers.

    With one level a chunk sends a blob to each bucket. With two it sends one to each slot of its group of chunks, and
    there the group's distinct keys go on to the slot's buckets. A group has as many chunks as a slot has buckets, so
    at either level rows are `most` a chunk at most, and they grow with the input.
    """

    slots: int
    finer: int = 1
    group: int = 1

    @classmethod
    def of(cls, keys: int, least: int, bucket_keys: int = 2_000_000, most: int = 1024) -> Deal:
        """Buckets of about `bucket_keys` keys, `least` at least."""
        buckets = max(least, keys // bucket_keys + 1)
        if buckets <= max(most, least):
            return cls(buckets)
        return cls(most, ceil(buckets / most), ceil(buckets / most))

    def order(self, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For keys in ascending order: positions by bucket, where each slot begins, and the bucket in the slot."""
        bucket = dealt.astype(np.uint64) * np.uint64(self.slots * self.finer) >> np.uint64(31)
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order].astype(np.int64)
        return order, np.searchsorted(ranked, np.arange(self.slots + 1) * self.finer), (ranked % self.finer).astype(np.uint16)

    def blobs(self, chunk: int, keys: np.ndarray, dealt: np.ndarray, numbers: np.ndarray | None = None) -> pa.Table:
        """What a chunk sends: a row for each slot that any of its ascending keys belongs to."""
        order, cut, finer = self.order(dealt)
        full = np.flatnonzero(np.diff(cut))
        part = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in full.tolist()], pa.binary())
        none = pa.nulls(len(full), pa.binary())
        return pa.table({
            "node": pa.array(full + (chunk // self.group * self.slots if self.finer > 1 else 0), pa.int64()), "part": pa.array([chunk] * len(full), pa.int64()),
            "keys": part(keys[order]), "finer": part(finer) if self.finer > 1 else none, "numbers": none if numbers is None else part(numbers[order].astype(np.uint32)),
        })


SENT = "node long, part long, keys binary, finer binary, numbers binary"
ANSWERS = "part long, node long, answer binary"


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, buckets in the slot, numbers (1 where none are sent), and where each row of a node begins."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
    finer = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(x, np.uint16) for x in table.column("finer").to_pylist() if x is not None]])
    numbers = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("numbers").to_pylist() if x is not None]])
    at = np.cumsum([0, *[len(x) // 8 for x in table.column("keys").to_pylist()]])
    return keys, finer if len(finer) else np.zeros(len(keys), np.uint16), numbers if len(numbers) else np.ones(len(keys), np.int64), at


def _distinct(keys: np.ndarray, finer: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, key) in order, their sums, and the place of each entry among them."""
    order = np.lexsort((keys, finer)) if finer.any() else np.argsort(keys, kind="stable")
    ranked, near = keys[order], finer[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (near[1:] != near[:-1])
    first = np.flatnonzero(new)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[first], near[first], np.add.reduceat(numbers[order], first) if len(first) else numbers, inverse


def met(sent: DataFrame, deal: Deal, answer, extra=None, kind: str = "") -> DataFrame:
    """Adds the numbers of equal keys over all chunks, and answers every blob that was sent.

    answer(sums) gives the bytes for one blob, or None for no answer. extra(keys, sums) gives one row of further columns
    (of the kind given) for each bucket. Rows: part (chunk), node, answer, and the further columns, which are null in
    answers.
    """
    names = [x.split()[0] for x in kind.split(", ")] if kind else []
    schema = ANSWERS + (f", {kind}" if kind else "")
    more = [f.dataType for f in T._parse_datatype_string(kind).fields] if kind else []
    arrow = [to_arrow_type(x) for x in more]

    def replying(tell):
        def reply(key: tuple, table: pa.Table) -> pa.Table:
            keys, finer, numbers, at = _joined(table)
            distinct, _, sums, inverse = _distinct(keys, finer, numbers)
            blobs = [tell(sums[inverse[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
            told = [k for k, x in enumerate(blobs) if x is not None]
            parts = table.column("part").to_pylist()
            row = [extra(distinct, sums)] if extra else []
            columns = {
                "part": pa.array([parts[k] for k in told] + [None] * len(row), pa.int64()), "node": pa.array([key[0].as_py()] * (len(told) + len(row)), pa.int64()),
                "answer": pa.array([blobs[k] for k in told] + [None] * len(row), pa.binary()),
            }
            return pa.table(columns | {name: pa.array([None] * len(told) + [r[name] for r in row], t) for name, t in zip(names, arrow, strict=True)})

        return reply

    if deal.finer == 1:
        return sent.groupBy("node").applyInArrow(replying(answer), schema)

    def send_on(key: tuple, table: pa.Table) -> pa.Table:
        keys, finer, numbers, _ = _joined(table)
        distinct, near, sums, _ = _distinct(keys, finer, numbers)
        cut = np.searchsorted(near, np.arange(deal.finer + 1))
        full = np.flatnonzero(np.diff(cut)).tolist()
        node = key[0].as_py()
        none = pa.nulls(len(full), pa.binary())
        return pa.table({
            "node": pa.array([node % deal.slots * deal.finer + k for k in full], pa.int64()), "part": pa.array([node] * len(full), pa.int64()),
            "keys": pa.array([distinct[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()), "finer": none,
            "numbers": pa.array([np.minimum(sums[cut[k] : cut[k + 1]], 2**32 - 1).astype(np.uint32).tobytes() for k in full], pa.binary()),
        })

    def hand_back(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, finer, numbers, at = _joined(left) if left.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(1, np.int64))
        _, near, sums, inverse = _distinct(keys, finer, numbers)
        cut = np.searchsorted(near, np.arange(deal.finer + 1))
        for node, blob in zip(right.column("node").to_pylist(), right.column("answer").to_pylist(), strict=True):
            own = slice(cut[node % deal.finer], cut[node % deal.finer + 1])
            sums[own] = np.frombuffer(blob, np.int64)
        blobs = [answer(sums[inverse[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        told = [k for k, x in enumerate(blobs) if x is not None]
        parts = left.column("part").to_pylist()
        return pa.table({"part": pa.array([parts[k] for k in told], pa.int64()), "node": pa.array([key[0].as_py() % deal.slots] * len(told), pa.int64()), "answer": pa.array([blobs[k] for k in told], pa.binary())})

    sent = stored(sent, "sent")
    # between the levels, sums are told in full
    found = stored(sent.groupBy("node").applyInArrow(send_on, SENT).groupBy("node").applyInArrow(replying(np.ndarray.tobytes), schema), "sums")
    up = found.filter("answer is not null").select(F.col("part").alias("_node"), "node", "answer")
    out = sent.groupBy("node").cogroup(up.groupBy("_node")).applyInArrow(hand_back, ANSWERS)
    if not kind:
        return out
    return out.select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(names, more, strict=True)]).unionByName(found.filter("answer is null"))


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each of n nodes the smallest node it is linked to, by rounds of smallest labels and their labels."""
    label = np.arange(n)
    while True:
        before = label
        label = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (src, dst): the smallest node it can reach.

    Each round hooks every node onto its smallest neighbour, follows the hooks to their ends, and goes on with the
    links between ends alone. An end that is left has taken in all its neighbours of two rounds before, so at least
    half of the nodes go every two rounds, in any order of ids, and rounds end when no link is left. Then each round's
    ends are looked up in those of the rounds after it. A node with very many links is aggregated before its rows are
    shuffled, and only joins that Spark can split see it whole.
    """
    both = edges.filter("src <> dst").select("src", "dst").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).dropDuplicates()
    links = stored(both, "links")
    rounds = []
    while not rounds or not links.isEmpty():
        ends = hook_ends(links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_m")).select("node", F.least("node", "_m").alias("component")))
        rounds.append(ends)
        a, b = (ends.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_to_{x}")) for x in ("src", "dst"))
        moved = links.join(a, F.col("src") == F.col("_src")).join(b, F.col("dst") == F.col("_dst")).filter("_to_src <> _to_dst")
        before, links = links, stored(moved.select(F.col("_to_src").alias("src"), F.col("_to_dst").alias("dst")).dropDuplicates(), "links")
        discard(before)
    labels = rounds.pop()
    while rounds:
        labels = stored(looked_up(rounds.pop(), labels).select("node", "component"), "labels")
    return labels


def looked_up(labels: DataFrame, after: DataFrame) -> DataFrame:
    """Each node's component replaced by that component's own in `after`, where it has one; before, as _was."""
    own = after.select(F.col("node").alias("_end"), F.col("component").alias("_up"))
    return labels.join(own, F.col("component") == F.col("_end"), "left").select("node", F.coalesce("_up", "component").alias("component"), F.col("component").alias("_was"))


def hook_ends(hooks: DataFrame) -> DataFrame:
    """(node, component) with each hook (node, component) followed to its end; steps double each time."""
    hooks = stored(hooks, "labels")
    while True:
        after = stored(looked_up(hooks, hooks), "labels")
        hooks = after.select("node", "component")
        if after.filter("component <> _was").isEmpty():
            return hooks

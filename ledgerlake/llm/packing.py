"""Mixture-controlled packing by deficit round-robin over source queues.

Documents become ids and are dealt by hash into packs of about `pack_tokens` ids, so every pack holds every source in
about its share. A source's target share is that of the corpus, or the one given. At the start of a pack each source
has the deficit that all packs before it left: its share of their ids less the ids they took of it. Within a pack
every window adds share * window to each source's deficit; queues are served in turn while their deficit pays for a
piece, and what is left is carried to the next window. The ids that a pack leaves over form sequences whose lengths
are powers of two, so no padding is needed.

Null or empty text: the end id alone. Null source: a queue of its own. Null doc_id: packed like any other. Repeated rows
are packed each for itself, and dealt by the partition that they come from too, so that no pack gets them all. A text of
any length is encoded in runs of bounded size and lies whole in one pack, in as many windows as it fills. Documents that
tie in their source and hash stand in the order of doc_id; of queues that are owed the same the first by name borrows.
Columns besides doc_id, text and source are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlake.llm.bpe import loaded
from ledgerlake.llm.shared import slices, stored, texts

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, ids, wide, row_hash); ids are unsigned little-endian, 2 bytes each, or 4 where `wide`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encoder.encode_batch(texts(part, "text"))
                raw, at = ids.tobytes(), np.concatenate([[0], np.cumsum(counts)]) * encoder.dtype.itemsize
                blobs = [raw[a:b] + end for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(counts + 1, pa.int64()), pa.array(blobs, pa.binary()), pa.array([encoder.dtype.itemsize == 4] * len(blobs), pa.bool_())],
                    names=["doc_id", "source", "row_hash", "n_tokens", "ids", "wide"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0null")).alias("source"), F.xxhash64("doc_id", "text", F.spark_partition_id()).alias("row_hash"), "text")
    return rows.mapInArrow(encode, "doc_id long, source string, row_hash long, n_tokens long, ids binary, wide boolean")


def schedule(queues: dict[str, deque], share: dict[str, float], deficit: dict[str, float], window: int = WINDOW, quantum: int = 256) -> list[list[tuple]]:
    """Windows of pieces (document, start, length) by deficit round-robin; the last window may be short.

    A queue is served while its deficit pays for the rest of its first document or for a quantum at least. If no
    queue can pay, the one with the largest deficit borrows a quantum, so a window is full while any queue has ids.
    """
    names = sorted(queues)
    total = sum(share.get(s, 0.0) for s in names) or 1.0
    share = {s: share.get(s, 0.0) / total for s in names}
    owed = {s: deficit.get(s, 0.0) for s in names}
    heads = {s: [0, queues[s][0][1]] for s in names if queues[s]}
    windows: list[list[tuple]] = []
    turn = 0
    while heads:
        room, pieces = window, []
        for s in names:
            owed[s] += share[s] * window

        def serve(s: str, most: int) -> int:
            head = heads[s]
            doc = queues[s][0][0]
            n = min(most, head[1])
            if pieces and pieces[-1][0] == doc and pieces[-1][1] + pieces[-1][2] == head[0]:
                pieces[-1] = (doc, pieces[-1][1], pieces[-1][2] + n)
            else:
                pieces.append((doc, head[0], n))
            head[0] += n
            head[1] -= n
            owed[s] -= n
            if not head[1]:
                queues[s].popleft()
                if queues[s]:
                    heads[s] = [0, queues[s][0][1]]
                else:
                    del heads[s]
            return n

        while room and heads:
            served = False
            for k in range(len(names)):
                s = names[(turn + k) % len(names)]
                while room and s in heads and owed[s] >= min(heads[s][1], quantum, room):
                    room -= serve(s, min(room, max(1, int(owed[s]))))
                    served = True
                if not room:
                    break
            if not served and room and heads:
                s = max(sorted(heads), key=owed.__getitem__)
                room -= serve(s, min(room, quantum))
        turn += 1
        windows.append(pieces)
    return windows


def halves(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """A short window as sequences whose lengths are the powers of two in its length, largest first."""
    total = sum(p[2] for p in pieces)
    if total == window:
        return [pieces]
    out, rest = [], deque(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & (1 << bit)
        if need:
            own = []
            while need:
                doc, start, length = rest.popleft()
                n = min(need, length)
                own.append((doc, start, n))
                need -= n
                if n < length:
                    rest.appendleft((doc, start + n, length - n))
            out.append(own)
    return out


def pack(docs: DataFrame, tokenizer: str, shares: dict[str, float] | None = None, window: int = WINDOW, quantum: int = 256, pack_tokens: int = 2_000_000, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids, each with its own ids."""
    coded = stored(tokenised(docs, tokenizer, end_id), "ids")
    total = coded.agg(F.sum("n_tokens")).first()[0] or 0
    packs = max(1, round(total / pack_tokens))
    rows = coded.withColumn("pack", F.pmod("row_hash", F.lit(packs)))
    held = rows.groupBy("pack", "source").agg(F.sum("n_tokens").alias("n"))
    per_pack = held.groupBy("pack").agg(F.sum("n").alias("pack_n"))
    # one row a pack (about total / 2 million rows), so the running sum over all packs fits one task
    before = per_pack.select("pack", (F.sum("pack_n").over(W.orderBy("pack")) - F.col("pack_n")).alias("n_before"))
    own = W.partitionBy("source")
    if shares is None:
        share = F.sum("n").over(own) / F.lit(float(max(total, 1)))
    else:
        pairs = [x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    plan = (
        held.withColumn("share", share)
        .withColumn("taken", F.sum("n").over(own.orderBy("pack")) - F.col("n"))
        .join(before.withColumnRenamed("pack", "_pack"), F.col("pack") == F.col("_pack"))
        .select(F.col("pack").alias("plan_pack"), F.col("source").alias("plan_source"), "share", (F.col("share") * F.col("n_before") - F.col("taken")).alias("deficit"))
    )

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = left.sort_by([("source", "ascending"), ("row_hash", "ascending"), ("doc_id", "ascending")])
        columns = {name: order.column(name).to_pylist() for name in ("doc_id", "source", "n_tokens", "ids", "wide")}
        queues: dict[str, deque] = {}
        for i, (source, n) in enumerate(zip(columns["source"], columns["n_tokens"], strict=True)):
            queues.setdefault(source, deque()).append((i, n))
        plan_of = right.to_pydict()
        share_of = dict(zip(plan_of["plan_source"], plan_of["share"], strict=True))
        owed = dict(zip(plan_of["plan_source"], plan_of["deficit"], strict=True))
        out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source")}
        first, sequence = key[0].as_py() << 32, 0
        for pieces in schedule(queues, share_of, owed, window, quantum):
            for own_pieces in halves(pieces, window):
                at = 0
                for i, start, n in own_pieces:
                    step = 4 if columns["wide"][i] else 2
                    out["doc_id"].append(columns["doc_id"][i])
                    out["start"].append(start)
                    out["length"].append(n)
                    out["ids"].append(np.frombuffer(columns["ids"][i], "<u4" if step == 4 else "<u2", n, start * step).astype("<u4").tobytes())
                    out["doc_tokens"].append(columns["n_tokens"][i])
                    out["sequence_id"].append(first + sequence)
                    out["offset"].append(at)
                    out["source"].append(columns["source"][i])
                    at += n
                sequence += 1
        kinds = {"ids": pa.binary(), "source": pa.string()}
        return pa.table({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items()})

    return rows.groupBy("pack").cogroup(plan.groupBy("plan_pack")).applyInArrow(run, PIECES)


def crc_of(pieces: DataFrame) -> DataFrame:
    """The pieces' digest columns, computed from their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")

"""Substring dedup by Rabin-Karp hashes of every fixed-length window of words.

Documents are dealt by hash into chunks. A chunk sends its distinct window hashes to the buckets of the hash space, once
each, so a passage that is everywhere costs one entry a chunk. A bucket counts the chunks that sent a hash and answers
each with one bit an entry. The chunk, which knows what repeats within itself, then covers the words of repeated
windows and merges them into maximal intervals. Beyond some thousand buckets hashes travel in two levels, by groups of
chunks, so that what a chunk sends never falls apart into a row a hash. Hashes have 62 bits, and are dealt into buckets
by a third prime, whose bits come on top: windows are compared by 62 bits and the logarithm of the buckets, which grow
with the input. Of a hundred million windows in 200 buckets two differ and count as one with a probability below 1e-5;
at 100 TB, in eight million buckets, a handful of the 1e13 windows do.

Null or empty text: no words, nothing removed, the empty text kept. Repeated rows: each is a document, so all their
windows repeat; rows that tie in all columns are dealt over chunks by the partition they come from. Texts shorter than
a window keep all words. A text of any length is read whole, in one chunk, and hashed in runs of bounded size. Columns
besides the text and `keep` are ignored, and those of `keep` pass unchanged under any name but n_words, spans and kept.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlake.llm.shared import SENT, Deal, met, window_hashes, with_chunks

SIZE = 35


def _hashed(table: pa.Table, size: int) -> tuple:
    words = [(x or "").encode().split() for x in table.column("_text").to_pylist()]
    hashes, counts, dealt = window_hashes(words, size, dealt=True)
    distinct, first, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return words, counts, distinct, dealt[first], inverse, times


def _shared(sums: np.ndarray) -> bytes | None:
    """One bit an entry: whether any other chunk sent it."""
    more = sums > 1
    return np.packbits(more).tobytes() if more.any() else None


def covered(repeated: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Of each word, whether a repeated window covers it."""
    edge = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(repeated)
    edge[starts] += 1
    edge[starts + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SIZE, deal: Deal | None = None) -> DataFrame:
    """(keep columns, n_words, spans, kept): intervals of words removed, stop excluded, and the words left, joined by a space."""
    rows, _, total = with_chunks(docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.col(text).cast("string").alias("_text")), "_text")
    # about a window every six bytes
    dealing = deal or Deal.of(total // 6, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, _, distinct, dealt, _, _ = _hashed(table, size)
        return dealing.blobs(key[0].as_py(), distinct, dealt)

    kinds = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType())])

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words, counts, _, dealt, inverse, times = _hashed(left, size)
        order, cut, _ = dealing.order(dealt)
        repeated = times > 1
        for slot, marks in zip(right.column("node").to_pylist(), right.column("answer").to_pylist(), strict=True):
            own = order[cut[slot] : cut[slot + 1]]
            repeated[own] |= np.unpackbits(np.frombuffer(marks, np.uint8), count=len(own)).astype(bool)
        flags = repeated[inverse]
        at = np.concatenate([[0], np.cumsum(counts)])
        spans, kept = [], []
        for k, own in enumerate(words):
            mine = flags[at[k] : at[k + 1]]
            if mine.any():
                gone = covered(np.concatenate([mine, np.zeros(size - 1, bool)]), len(own), size)
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
                spans.append([{"start": a, "stop": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                kept.append(b" ".join([own[i] for i in np.flatnonzero(~gone).tolist()]).decode())
            else:
                spans.append([])
                kept.append(b" ".join(own).decode())
        columns = [left.column(f"_k_{c}") for c in keep]
        span_kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.Table.from_arrays([*columns, pa.array(map(len, words), pa.int64()), pa.array(spans, span_kind), pa.array(kept, pa.string())], names=[f.name for f in schema.fields])

    sent = rows.groupBy("chunk").applyInArrow(send, SENT)
    marks = met(sent, dealing, _shared)
    return rows.groupBy("chunk").cogroup(marks.groupBy("part")).applyInArrow(remove, schema)


def removed_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])

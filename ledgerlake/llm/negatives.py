"""Hard-negative mining by dense products of anchor blocks with candidate blocks.

Anchors are cut into blocks of a stated size, and one block at a time is broadcast; each task streams its share of the
candidates past it, multiplies blocks in doubles (exact, see vectors.products), and keeps the best few of each anchor.
These merge by a rank in Spark. A first pass finds each anchor's positives, a second its negatives within the window
that each positive sets. Before each pass the same search over a 64th of the candidates gives every anchor a score that
its last place must reach at least, so tasks send little, however many there are; it never changes the result.

Scores are whole numbers, higher first, ties by smaller id. Rows with a null id, label or vector, or with a vector
that has no whole numbers (see vectors), take no part; vectors meet only those of their length. Rows that repeat an
id are rows of their own: each is an anchor, a positive or a negative for itself, never its own positive. Of equal
vectors of one label in a batch only the smallest ids are compared, as many as could be returned. An empty table,
anchors without positives and positives without negatives give no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.shared import shared_folder, stored
from ledgerlake.llm.vectors import products, unpacked, with_whole

#: Below every score, and above every score.
NONE, TOP = -(2**62), 2**62
ROWS, COLUMNS = 1024, 2048
FOUND = "slot long, anchor_id long, positive_id long, positive_score long, id long, score long"


@dataclass
class Block:
    """Anchors of one vector size, and what each looks for: `low` to `high` are the scores of its windows."""

    size: int
    first: int  # the number of its first slot in the block
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive_id: np.ndarray
    positive_score: np.ndarray


class Best:
    """The best `k` (score, id) of each slot so far."""

    def __init__(self, slots: int, k: int):
        self.scores = np.full((slots, k), NONE)
        self.ids = np.full((slots, k), TOP)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        some = np.unique(slots)
        slots = np.concatenate([slots, np.repeat(some, k)])
        scores = np.concatenate([scores, self.scores[some].ravel()])
        ids = np.concatenate([ids, self.ids[some].ravel()])
        order = np.lexsort((ids, -scores, slots))
        begins = np.searchsorted(slots[order], some)
        best = order[begins[:, None] + np.arange(k)]
        self.scores[some], self.ids[some] = scores[best], ids[best]


def smallest_ids(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest ids of each distinct (label, vector)."""
    both = np.ascontiguousarray(np.column_stack([labels, vectors]))
    _, which = np.unique(both.view(np.dtype((np.void, both.itemsize * both.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    begins = np.searchsorted(which[order], which[order])
    return order[np.arange(len(order)) - begins < k]


def search(block: Block, best: Best, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool) -> None:
    """Offers each window of the block the candidates of the anchor's label (same) or of others."""
    k, windows = best.scores.shape[1], block.low.shape[1]
    for a in range(0, len(block.ids), ROWS):
        rows = slice(a, a + ROWS)
        for b in range(0, len(ids), COLUMNS):
            scores = products(block.vectors[rows], vectors[b : b + COLUMNS])
            fits = (block.labels[rows, None] == labels[None, b : b + COLUMNS]) == same
            for w in range(windows):
                slots = np.arange(a, min(a + ROWS, len(block.ids))) * windows + w
                low = np.maximum(block.low[rows, w], best.scores[slots, -1])
                hit = fits & (scores >= low[:, None].astype(scores.dtype)) & (scores <= block.high[rows, w, None].astype(scores.dtype))
                many = np.flatnonzero(hit.sum(1) > 4 * k)
                if len(many):  # of these, no more than the k best and what ties with the last
                    own = np.where(hit[many], scores[many], NONE)
                    hit[many] &= own >= np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k, None]
                i, j = np.nonzero(hit)
                if len(i):
                    best.offer(slots[i], scores[i, j].astype(np.int64), ids[b + j])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each slot over all tasks, by rank from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def found_in(candidates: DataFrame, blocks: list[Block], k: int, same: bool) -> DataFrame:
    """Each task's best k of each slot of the broadcast blocks."""
    sent = candidates.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {x.size: (x, Best(x.low.size, k)) for x in sent.value}
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for n in np.unique(size).tolist():
                if n in own:
                    part = batch.take(pa.array(np.flatnonzero(size == n)))
                    ids, labels, vectors = np.asarray(part.column("vec_id")), np.asarray(part.column("label")), unpacked(part.column("q"), n)
                    keep = smallest_ids(ids, labels, vectors, k)
                    search(*own[n], ids[keep], labels[keep], vectors[keep], same)
        for block, best in own.values():
            slot, place = np.nonzero(best.scores > NONE)
            row, w = np.divmod(slot, block.low.shape[1])
            for i in range(0, len(slot), 100_000):
                at = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    block.first + slot[at], block.ids[row[at]], block.positive_id[row[at], w[at]], block.positive_score[row[at], w[at]], best.ids[slot[at], place[at]], best.scores[slot[at], place[at]]
                )], names=["slot", "anchor_id", "positive_id", "positive_score", "id", "score"])

    return candidates.select("vec_id", "label", "size", "q").mapInArrow(run, FOUND)


def raised(candidates: DataFrame, blocks: list[Block], k: int, same: bool) -> None:
    """Raises each window's low end to the k-th best score among a 64th of the candidates, where that has so many."""
    some = candidates.filter(F.pmod(F.xxhash64("vec_id", "q"), F.lit(64)) == 0)
    last = ranked(found_in(some, blocks, k, same), k).filter(F.col("rank") == k).select("slot", "score").toArrow()
    slots, scores = (np.asarray(last.column(c).combine_chunks(), np.int64) for c in ("slot", "score"))
    for block in blocks:
        own = (slots >= block.first) & (slots < block.first + block.low.size)
        block.low.ravel()[slots[own] - block.first] = scores[own]


def with_positives(blocks: list[Block], found: pa.Table, positives: int) -> list[Block]:
    """The blocks with a window below each positive: from 4/5 of its score up to its score."""
    table = found.sort_by([("slot", "ascending"), ("rank", "ascending")])
    slots, ids, scores = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("slot", "id", "score"))
    out, first = [], 0
    for block in blocks:
        n = len(block.ids)
        own = (block.vectors * block.vectors).sum(1)
        at = [np.searchsorted(slots, block.first + np.arange(n) + x) for x in (0, 1)]
        positive_id, positive_score = np.zeros((n, positives), np.int64), np.full((n, positives), NONE)
        for row, (a, b) in enumerate(zip(*at, strict=True)):
            me = np.flatnonzero((ids[a:b] == block.ids[row]) & (scores[a:b] == own[row]))[:1]  # a row isn't its own positive
            rest = np.delete(np.arange(a, b), me)[:positives]
            positive_id[row, : len(rest)], positive_score[row, : len(rest)] = ids[rest], scores[rest]
        there = positive_score > NONE
        low = np.where(there, -((-4 * np.where(there, positive_score, 0)) // 5), TOP)  # 80 p <= 100 n
        out.append(Block(block.size, first, block.ids, block.labels, block.vectors, low, np.where(there, positive_score, NONE), positive_id, positive_score))
        first += low.size
    return out


def hard_negatives(rows: DataFrame, anchor: Column, vector: str = "embedding", ident: str = "vec_id", label: Column | None = None, scale: float = 256, positives: int = 5, negatives: int = 5, block_bytes: int = 16_000_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `anchor` holds and each of its best `positives` rows of the same label, the best `negatives` of other labels whose score is at most the positive's and at least 4/5 of it.

    A broadcast block holds anchors of about `block_bytes`, with a task's results for them.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(ident).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("_vector"))
    whole = with_whole(plain.filter("vec_id is not null and label is not null"), "_vector", scale)
    candidates = stored(whole.filter("q is not null"), "candidates")
    out = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    each = F.col("size") * 8 + 24 * (positives + 1) * (negatives + 2)
    chosen = candidates.filter("anchor").select("vec_id", "label", "size", "q")
    total = chosen.agg(F.sum(each)).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    # dealt by a number a row has, so that rows alike in all columns don't share a block
    dealt = stored(chosen.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))), "anchors")
    answer = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], answer).write.parquet(out)
    for part in range(parts):
        table = dealt.filter(F.col("part") == part).toArrow()
        blocks, first = [], 0
        sizes = np.asarray(table.column("size").combine_chunks(), np.int64)
        for size in np.unique(sizes).tolist():
            own = table.take(pa.array(np.flatnonzero(sizes == size)))
            ids, labels = (np.asarray(own.column(c).combine_chunks(), np.int64) for c in ("vec_id", "label"))
            none = np.zeros((len(ids), 1), np.int64)
            blocks.append(Block(size, first, ids, labels, unpacked(own.column("q"), size), none + NONE + 1, none + TOP, none, none))
            first += len(ids)
        if not blocks:
            continue
        k = positives + 1  # the row itself is among them
        raised(candidates, blocks, k, True)
        blocks = with_positives(blocks, ranked(found_in(candidates, blocks, k, True), k).select("slot", "rank", "id", "score").toArrow(), positives)
        raised(candidates, blocks, negatives, False)
        best = ranked(found_in(candidates, blocks, negatives, False), negatives)
        best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(answer).parquet(out)

"""Language-model scoring: add-0.1 unigrams, and a hashed maximum-entropy model with class-factored softmax.

Encoding. Texts become numbers once: a chunk of about `CHUNK` bytes is a row with the sorted keys of its distinct words,
their counts in training documents, and its tokens as positions among them, written to the shared folder. A text longer
than that is cut between words into pieces, which begin with the words before them as context. Counting, training and
scoring read these rows.

Counting. A chunk sends each bucket of the hash space its keys with their counts, once each. A bucket adds them up and
answers every chunk. So what is gathered follows the corpus, and a word that is everywhere costs one entry a chunk.

Model. A token has a path of LEVELS digits, its classes within classes, and P(token | context) is the product of one
softmax over WIDTH digits a level. The path of a frequent word is its rank; all other words share the other half of the
paths, by their endings and hashes, and within a path's last class each has its add-0.1 unigram. The number of levels
follows the logarithm of the root of the training tokens, so frequent words and paths grow with the corpus. Each level's
weights are rows that hashes of (feature, classes so far) pick: the bias, the words one to three before, and the last
two together. Features are hashes of the words themselves, so every word has its own. Biases begin at the classes'
shares, so that training starts from the unigrams.

Training. Each round deals chunks once over; tasks take minibatch Adagrad steps from the same weights, and a row's steps
are averaged over the tasks that took any, by how many, in groups of tasks and groups of groups. Scoring reads the
weights and the chunk's own counts, in numpy batches. What is broadcast is bounded: MOST_ROWS rows of weights, 5 levels.

Null or empty text: the end token alone. Repeated rows are scored and counted each. Of words that tie in their counts
the one with the smaller key has the better rank. A null doc_id counts as held out. Without training documents counts
are 0 and the model is uniform over classes. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.classifier import fold
from ledgerlake.llm.shared import SENT, Deal, byte_hashes, met, slices, stored

CHUNK = 1_500_000
BITS = 4
WIDTH = 1 << BITS
MOST_LEVELS, MOST_ROWS = 5, 1 << 18
#: Words of context; the features are the bias, one for each of them, and one for the nearest two together.
CONTEXT = 3
FEATURES = CONTEXT + 1
END_KEY = np.uint64(1) << np.uint64(63)
ONES = np.ones(WIDTH, np.float32)
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PART = 256
WHITE = re.compile(rb"[\x20\x09-\x0D]")
CODED = "chunk long, docs array<long>, held array<boolean>, rows array<long>, lengths array<int>, skips array<int>, keys binary, numbers binary, flat binary"
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?*#$%&|<>\"'()")] = True


def dealt(keys: np.ndarray) -> np.ndarray:
    """The 31-bit dealing numbers of keys."""
    return ((keys ^ keys >> np.uint64(31)) * MIX >> np.uint64(33)).astype(np.int64)


def keys_of(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit keys of words: the hash but for its lowest four bits, which hold the class of the last two letters."""
    high, low = byte_hashes(raw, begins, ends)
    hashes = high.astype(np.uint64) << np.uint64(31) | low.astype(np.uint64)
    last = ends - 1
    for _ in range(2):
        last = np.where(PUNCTUATION[raw[last]] & (last > begins), last - 1, last)
    before = np.where(last > begins, raw[last - 1], 0)
    ending = (before.astype(np.uint64) * np.uint64(256) + raw[last]) * np.uint64(40_503) >> np.uint64(4)
    return hashes & ~np.uint64(15) | ending & np.uint64(15)


def pieces_of(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about `most` bytes, cut between words, and how many words of each belong to the one before."""
    start, context = 0, []
    while True:
        white = WHITE.search(text, start + most)
        stop = white.start() if white else len(text)
        yield b" ".join([*context, text[start:stop]]), len(context)
        if stop == len(text):
            return
        context = [*context, *text[start:stop].split()[-CONTEXT:]][-CONTEXT:]
        start = stop


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of distinct words, all words as positions among them, and the words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    coded = flat.dictionary_encode()
    words = coded.dictionary
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(1, np.uint8)
    some = np.flatnonzero(np.diff(at) > 0)
    keys = np.zeros(len(words), np.uint64)
    if len(some):
        keys[some] = keys_of(raw, at[some], at[some + 1])
    return keys, np.asarray(coded.indices)[full], np.bincount(owner[full], minlength=len(column))


def chunk_row(chunk: int, column: pa.Array, docs: list, held: list[bool], rows: list[int], skips: list[int], last: list[bool]) -> dict:
    """The row of a chunk of pieces; the end token follows each document's last piece."""
    keys, words, counts = tokens_of(column)
    ends = np.asarray(last, bool)
    # the end token stands last among the words found, and goes to its place in the sorted keys with them
    shift = np.repeat(np.cumsum(ends) - ends, counts)
    flat = np.full(len(words) + int(ends.sum()), len(keys), np.int64)
    flat[np.arange(len(words)) + shift] = words
    every = np.append(keys, END_KEY)
    distinct, place = np.unique(every, return_inverse=True)
    flat = place[flat]
    lengths = counts + ends
    index = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = np.repeat(~np.asarray(held, bool), lengths) & (index >= np.repeat(np.asarray(skips), lengths))
    numbers = np.bincount(flat[own], minlength=len(distinct))
    return {
        "chunk": chunk, "docs": docs, "held": held, "rows": rows, "lengths": lengths.tolist(), "skips": skips,
        "keys": distinct.tobytes(), "numbers": numbers.astype(np.uint32).tobytes(), "flat": flat.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32).tobytes(),
    }


def encoded(docs: DataFrame, folds: int, chunk_bytes: int = CHUNK) -> DataFrame:
    """Chunks of documents as numbers, stored. rows: a number of the document's row where it has several pieces, else null."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 20
        n = 0

        def out(*args) -> pa.RecordBatch:
            row = chunk_row(first + n, *args)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                ids, held = part.column(0).to_pylist(), part.column(1).to_pylist()
                if part.num_rows > 1 or len(part.column(2)[0].as_buffer() or b"") <= 2 * chunk_bytes:
                    yield out(part.column(2), ids, held, [None] * len(ids), [0] * len(ids), [True] * len(ids))
                    n += 1
                    continue
                cut = list(pieces_of(part.column(2)[0].as_buffer().to_pybytes(), chunk_bytes))
                for k, (piece, skip) in enumerate(cut):
                    yield out(pa.array([piece]).cast(pa.binary()).view(pa.string()), ids, held, [first + n - k], [skip], [k == len(cut) - 1])
                    n += 1

    rows = docs.select("doc_id", (fold("doc_id", folds) == 0).alias("held"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, CODED), "coded")


class Paths:
    """The tree of classes: how deep it is, the frequent words, and what the last classes of all others count."""

    def __init__(self, levels: int, head_keys: np.ndarray, head_counts: np.ndarray, tokens: np.ndarray, types: np.ndarray, total: int, n_types: int):
        self.levels, self.total, self.n_types = levels, total, n_types
        order = np.argsort(head_keys)
        self.keys, self.ranks = head_keys[order], order
        self.tokens, self.types = tokens.astype(float), types.astype(float)
        words = head_keys != END_KEY
        own = leaf_of(head_keys[words], levels) - half(levels)
        # the frequent words leave the totals of the classes that they would have had
        self.tokens -= np.bincount(own, head_counts[words], half(levels))
        self.types -= np.bincount(own, minlength=half(levels))
        self.mass = np.concatenate([np.pad(head_counts.astype(float), (0, half(levels) - len(head_counts))), self.tokens])

    def leaves(self, keys: np.ndarray) -> np.ndarray:
        """The path of each key, as one number."""
        out = leaf_of(keys, self.levels)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out[found] = self.ranks[at[found]]
        return out

    def inside(self, keys: np.ndarray, leaves: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its last class: all of it for a frequent word, else its add-0.1 unigram there."""
        own = np.maximum(leaves - half(self.levels), 0)
        share = np.log10((counts + 0.1) / (self.tokens[own] + 0.1 * (self.types[own] + 1)))
        return np.where(leaves < half(self.levels), 0.0, share)


def half(levels: int) -> int:
    """How many paths there are for frequent words, and as many for all others."""
    return 1 << (BITS * levels - 1)


def levels_for(tokens: int) -> int:
    return int(min(MOST_LEVELS, max(2, round(log(max(tokens, 2)) / 2 / log(WIDTH)))))


def leaf_of(keys: np.ndarray, levels: int) -> np.ndarray:
    """The path of a word that isn't frequent: by its ending first, then by its hash."""
    bits = BITS * levels - 1
    rest = (keys >> np.uint64(4)) * STIR >> np.uint64(64 - (bits - 4))
    return half(levels) + ((keys & np.uint64(15)) << np.uint64(bits - 4) | rest).astype(np.int64)


def n_nodes(levels: int) -> int:
    return ((1 << BITS * levels) - 1) // (WIDTH - 1)


def n_rows(levels: int) -> int:
    """Rows of weights: the biases, and sixteen for each path up to the bound."""
    return n_nodes(levels) + min(MOST_ROWS, 1 << (BITS * levels + 4))


def examples_of(keys: np.ndarray, leaves: np.ndarray, flat: np.ndarray, lengths: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of weights that are active (features x examples), and each example's right digit; a token has `levels`."""
    n = len(flat)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = ((keys ^ keys >> np.uint64(29)) * STIR)[flat]
    before = []
    for skip in range(1, CONTEXT + 1):
        shifted = np.zeros(n, np.uint64)
        shifted[skip:] = own[:-skip] if n > skip else own[:0]
        shifted[place < skip] = 1
        before.append(shifted)
    contexts = [(x + np.uint64(k + 1)) * MIX for k, x in enumerate(before)] + [before[0] * MIX + before[1] * STIR]
    path = leaves[flat]
    nodes = n_nodes(levels)
    bits = np.uint64(64 - (n_rows(levels) - nodes).bit_length() + 1)
    rows = np.empty((FEATURES + 1, levels, n), np.int64)
    digits = np.empty((levels, n), np.int64)
    for level in range(levels):
        above = path >> BITS * (levels - level)
        digits[level] = path >> BITS * (levels - level - 1) & (WIDTH - 1)
        np.add(above, ((1 << BITS * level) - 1) // (WIDTH - 1), out=rows[0, level])
        salt = (rows[0, level].astype(np.uint64) + np.uint64(1)) * MIX
        for k, context in enumerate(contexts):
            x = (context ^ salt) * STIR
            np.right_shift(x, bits, out=x)
            np.add(x.view(np.int64), nodes, out=rows[k + 1, level])
    return rows.reshape(FEATURES + 1, -1), digits.ravel()


def exponentials(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the summed weights of each example's rows, and their sum over the digits."""
    z = np.take(weights, rows[0], axis=0)
    one = np.empty_like(z)
    for own in rows[1:]:
        np.take(weights, own, axis=0, out=one, mode="clip")
        z += one
    if z.size and z.max() > 60:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ ONES


def initial(paths: Paths) -> np.ndarray:
    """Weights of no feature but the bias, which has each class's share of the training tokens."""
    out = np.zeros((n_rows(paths.levels), WIDTH), np.float32)
    mass = paths.mass + 0.1
    for level in reversed(range(paths.levels)):
        first = ((1 << BITS * level) - 1) // (WIDTH - 1)
        shares = mass.reshape(-1, WIDTH)
        out[first : first + len(shares)] = np.log(shares / shares.sum(1, keepdims=True))
        mass = shares.sum(1)
    return out


def whole_rows(table: np.ndarray) -> np.ndarray:
    """The table's rows as single items, which numpy moves faster."""
    return table.view(f"V{table.itemsize * WIDTH}").ravel()


class Learner:
    """Weights under Adagrad, and how many steps each row has taken."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.start, self.weights, self.rate = weights, weights.copy(), rate
        self.squares = np.full(len(weights), 1e-2, np.float32)
        self.steps = np.zeros(len(weights), np.float32)

    def step(self, rows: np.ndarray, digits: np.ndarray) -> None:
        """One step on a minibatch of up to 2**16 examples; a row's step size is from its squared gradients so far."""
        slope, total = exponentials(self.weights, rows)
        slope /= total[:, None]
        slope.ravel()[np.arange(0, slope.size, WIDTH) + digits] -= 1
        # rows of one number stand together, each with its example in the lowest bits; biases stay as they began
        packed = (rows[1:] << 16 | np.arange(len(digits))).ravel()
        packed.sort()
        ranked = packed >> 16
        begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        distinct = ranked[begin]
        packed &= 0xFFFF
        sums = np.take(slope, packed[begin], axis=0)
        sizes = np.diff(np.append(begin, len(packed)))
        several = np.flatnonzero(sizes > 1)
        if len(several):
            own = sizes[several]
            together = np.take(slope, packed[np.repeat(sizes > 1, sizes)], axis=0)
            whole_rows(sums)[several] = whole_rows(np.add.reduceat(together, np.cumsum(own) - own, axis=0))
        squares = np.take(self.squares, distinct) + (sums * sums) @ ONES
        self.squares[distinct] = squares
        sums *= (-self.rate / np.sqrt(squares))[:, None]
        sums += np.take(self.weights, distinct, axis=0)
        whole_rows(self.weights)[distinct] = whole_rows(sums)
        self.steps[distinct] += 1

    def moved(self) -> pa.RecordBatch:
        """The rows that have moved, by parts of PART rows: which, their steps, and steps times the way they went."""
        some = np.flatnonzero(self.steps)
        cut = np.searchsorted(some, np.arange(0, len(self.steps) + PART, PART))
        parts = np.flatnonzero(np.diff(cut))
        way = (self.weights[some] - self.start[some]) * self.steps[some][:, None]
        blob = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in parts.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(parts), blob((some % PART).astype(np.uint16)), blob(self.steps[some]), blob(way.astype(np.float32))], names=["part", "at", "steps", "way"])


def added(key: tuple, table: pa.Table) -> pa.Table:
    """Steps and ways of one part of the weights, added up over tasks or groups of tasks."""
    steps, way = np.zeros(PART), np.zeros((PART, WIDTH))
    for at, n, go in zip(*[table.column(c).to_pylist() for c in ("at", "steps", "way")], strict=True):
        own = np.frombuffer(at, np.uint16)
        steps[own] += np.frombuffer(n, np.float32)
        way[own] += np.frombuffer(go, np.float32).reshape(-1, WIDTH)
    some = np.flatnonzero(steps)
    task = table.column("task")[0].as_py() // 64
    return pa.table({
        "task": pa.array([task], pa.int64()), "part": pa.array([key[-1].as_py()], pa.int64()), "at": pa.array([some.astype(np.uint16).tobytes()], pa.binary()),
        "steps": pa.array([steps[some].astype(np.float32).tobytes()], pa.binary()), "way": pa.array([way[some].astype(np.float32).tobytes()], pa.binary()),
    })


MOVED = "task long, part long, at binary, steps binary, way binary"


def of_training(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, tokens, lengths and skips of a chunk's pieces."""
    keys = np.frombuffer(row["keys"], np.uint64)
    flat = np.frombuffer(row["flat"], np.uint16 if len(keys) <= 1 << 16 else np.uint32).astype(np.int64)
    return keys, flat, np.asarray(row["lengths"], np.int64), np.asarray(row["skips"], np.int64)


def runs_of(keys: np.ndarray, leaves: np.ndarray, flat: np.ndarray, lengths: np.ndarray, levels: int, most: int = 20_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole pieces: the tokens from and to, their rows of weights, and their digits, level by level."""
    ends = np.cumsum(lengths)
    k = at = 0
    while k < len(lengths):
        stop = max(k + 1, int(np.searchsorted(ends, at + most, side="right")))
        end = int(ends[stop - 1])
        yield at, end, *examples_of(keys, leaves, flat[at:end], lengths[k:stop], levels)
        at, k = end, stop


def train_chunk(learner: Learner, paths: Paths, row: dict, batch: int) -> None:
    """Steps over the tokens of a chunk's training documents, `batch` tokens of one level at a time."""
    keys, flat, lengths, skips = of_training(row)
    held = np.asarray(row["held"], bool)
    if held.any():
        flat, lengths, skips = flat[np.repeat(~held, lengths)], lengths[~held], skips[~held]
    index = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = index >= np.repeat(skips, lengths)
    for at, end, rows, digits in runs_of(keys, paths.leaves(keys), flat, lengths, paths.levels):
        if skips.any():
            some = np.tile(own[at:end], paths.levels)
            rows, digits = rows[:, some], digits[some]
        for k in range(0, len(digits), batch):
            learner.step(rows[:, k : k + batch], digits[k : k + batch])


def trained(coded: DataFrame, paths: Paths, rounds: int = 2, batch: int = 4096, rate: float = 0.4) -> np.ndarray:
    """The weights after `rounds` rounds over disjoint parts of the chunks, together one pass."""
    weights = initial(paths)
    tasks = coded.rdd.getNumPartitions()
    for turn in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast((paths, weights))  # bounded: see MOST_ROWS and MOST_LEVELS
        own_rate = rate / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, own_rate=own_rate) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            tree, start = shared.value
            learner = Learner(start, own_rate)
            for arrow in batches:
                for k in range(arrow.num_rows):
                    train_chunk(learner, tree, arrow.slice(k, 1).to_pylist()[0], batch)
            out = learner.moved()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * out.num_rows, pa.int64()), *out.columns], names=["task", *out.schema.names])

        some = coded.filter(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == turn)
        moved = some.select("held", "lengths", "skips", "keys", "flat").mapInArrow(run, MOVED)
        left = tasks
        while left > 64:
            moved = moved.groupBy(F.floor(F.col("task") / 64).alias("_group"), "part").applyInArrow(added, MOVED)
            left = -(-left // 64)
        found = moved.groupBy("part").applyInArrow(added, MOVED).toArrow()
        weights = weights.copy()
        for part, at, n, way in zip(*[found.column(c).to_pylist() for c in ("part", "at", "steps", "way")], strict=True):
            weights[part * PART + np.frombuffer(at, np.uint16).astype(np.int64)] += np.frombuffer(way, np.float32).reshape(-1, WIDTH) / np.frombuffer(n, np.float32)[:, None]
    return weights


def score_chunk(paths: Paths, weights: np.ndarray, row: dict, counts: np.ndarray, batch: int = 4096) -> dict:
    """Per piece: tokens, known tokens, base score and score; counts are those of the chunk's keys over all training documents."""
    keys, flat, lengths, skips = of_training(row)
    leaves = paths.leaves(keys)
    inside = paths.inside(keys, leaves, counts)
    base = np.log10((counts + 0.1) / (paths.total + 0.1 * (paths.n_types + 1)))
    each = inside[flat]
    for at, end, rows, digits in runs_of(keys, leaves, flat, lengths, paths.levels):
        found = np.empty(len(digits))
        for k in range(0, len(digits), batch):
            e, total = exponentials(weights, rows[:, k : k + batch])
            found[k : k + batch] = np.log10(e.ravel()[np.arange(0, e.size, WIDTH) + digits[k : k + batch]] / total)
        each[at:end] += found.reshape(paths.levels, -1).sum(0)
    starts = np.cumsum(lengths) - lengths
    index = np.arange(len(flat)) - np.repeat(starts, lengths)
    own = index >= np.repeat(skips, lengths)
    which = np.repeat(np.arange(len(lengths)), lengths)
    add = lambda x: np.bincount(which, np.where(own, x, 0), len(lengths))
    return {"n_tokens": add(np.ones(len(flat))).astype(np.int64), "n_known": add(counts[flat] > 0).astype(np.int64), "base_score": add(base[flat]), "score": add(each)}


def counted(coded: DataFrame, levels: int, train_tokens: int, deal: Deal | None = None) -> tuple[DataFrame, Deal]:
    """Answers to each chunk, and of each bucket its totals, its frequent words and its last classes, as one stored table."""
    size = coded.agg(F.sum(F.octet_length("keys") / 8).alias("keys"), F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.shiftright("chunk", 20)).alias("parts")).first()
    least = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if deal is None:
        deal = Deal.of(int(size["keys"] or 0), least)
        # chunk numbers are dense only within the partitions that wrote them
        deal = Deal(deal.slots, deal.finer, max(1, deal.group * (size["parts"] or 1) // max(1, size["chunks"])) << 20)
    often = train_tokens / (128 * half(levels))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, keys, numbers = (batch.column(i)[row].as_py() for i in range(3))
                own = np.frombuffer(keys, np.uint64)
                yield from deal.blobs(chunk, own, dealt(own), np.frombuffer(numbers, np.uint32)).to_batches()

    def extra(keys: np.ndarray, sums: np.ndarray) -> dict:
        some = sums > 0
        words = some & (keys != END_KEY)
        leaves = leaf_of(keys[words], levels) - half(levels)
        found, place = np.unique(leaves, return_inverse=True)
        tokens, types = np.bincount(place, sums[words], len(found)), np.bincount(place, minlength=len(found))
        top = np.flatnonzero(some & (sums >= often))
        return {
            "n_types": int(some.sum()),
            "leaves": [{"leaf": int(a), "tokens": int(b), "types": int(c)} for a, b, c in zip(found, tokens, types, strict=True)],
            "top": [{"key": int(k), "n": int(n)} for k, n in zip(keys[top].view(np.int64), sums[top], strict=True)],
        }

    sent = coded.select("chunk", "keys", "numbers").mapInArrow(send, SENT)
    kind = "n_types long, leaves array<struct<leaf:long,tokens:long,types:long>>, top array<struct<key:long,n:long>>"
    return stored(met(sent, deal, lambda sums: sums.astype(np.int64).tobytes(), extra, kind), "counts"), deal


def paths_of(counts: DataFrame, levels: int, train_tokens: int) -> Paths:
    """The tree, from the buckets' rows: of frequent words the first half(levels), and what each last class counts."""
    own = counts.filter("answer is null")
    n_types = own.agg(F.sum("n_types")).first()[0] or 0
    top = own.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "key").limit(half(levels)).toArrow()
    leaves = own.select(F.explode("leaves").alias("l")).groupBy("l.leaf").agg(F.sum("l.tokens").alias("tokens"), F.sum("l.types").alias("types")).toArrow()
    tokens, types = np.zeros(half(levels)), np.zeros(half(levels))
    at = np.asarray(leaves.column("leaf"), np.int64)
    tokens[at], types[at] = np.asarray(leaves.column("tokens")), np.asarray(leaves.column("types"))
    return Paths(levels, np.asarray(top.column("key"), np.int64).view(np.uint64), np.asarray(top.column("n"), np.int64), tokens, types, train_tokens, int(n_types))


def fitted(docs: DataFrame, folds: int = 10, rounds: int = 2, chunk_bytes: int = CHUNK, deal: Deal | None = None) -> tuple[DataFrame, DataFrame, Deal, Paths, np.ndarray]:
    """Chunks, counts, how they were dealt, the tree and the weights."""
    coded = encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), folds, chunk_bytes)
    known = F.aggregate(F.zip_with("lengths", "skips", lambda a, b: a - b), F.lit(0).cast("long"), lambda a, b: a + b)
    held = F.aggregate(F.zip_with(F.zip_with("lengths", "skips", lambda a, b: a - b), "held", lambda a, b: F.when(b, a).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    train_tokens = coded.agg(F.sum(known - held)).first()[0] or 0
    levels = levels_for(train_tokens)
    counts, dealing = counted(coded, levels, train_tokens, deal)
    paths = paths_of(counts, levels, train_tokens)
    return coded, counts, dealing, paths, trained(coded, paths, rounds)


def score(docs: DataFrame, folds: int = 10, rounds: int = 2, chunk_bytes: int = CHUNK, deal: Deal | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    coded, counts, dealing, paths, weights = fitted(docs, folds, rounds, chunk_bytes, deal)
    shared = docs.sparkSession.sparkContext.broadcast((paths, weights))  # bounded: see MOST_ROWS and MOST_LEVELS

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tree, own_weights = shared.value
        row = left.to_pylist()[0]
        keys = np.frombuffer(row["keys"], np.uint64)
        order, cut, _ = dealing.order(dealt(keys))
        times = np.zeros(len(keys), np.int64)
        for slot, answer in zip(right.column("node").to_pylist(), right.column("answer").to_pylist(), strict=True):
            times[order[cut[slot] : cut[slot + 1]]] = np.frombuffer(answer, np.int64)
        found = score_chunk(tree, own_weights, row, times)
        return pa.table({"doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "row": pa.array(row["rows"], pa.int64()), **found})

    answers = counts.filter("answer is not null").select("part", "node", "answer")
    scored = coded.drop("numbers").groupBy("chunk").cogroup(answers.groupBy("part")).applyInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double")
    names = ("n_tokens", "n_known", "base_score", "score")
    # the pieces of a long text are added up
    scored = stored(scored, "scored")
    whole = scored.filter("row is null").select("doc_id", "held_out", *names)
    cut = scored.filter("row is not null").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in names])
    out = whole.unionByName(cut.select("doc_id", "held_out", *names))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(paths.total).cast("long").alias("train_tokens"), "base_score", "score")

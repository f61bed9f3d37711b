"""Byte-level BPE by batched numpy merge rounds.

Texts are cut where the tokenizer's own split is certain to begin a new part (a space before a letter, punctuation
after a letter, a single line end), and the pieces are hashed all at once. Pieces not yet in the table become symbols
in one flat array. A round looks neighbouring pairs up by binary search in the sorted pair keys (left id * vocabulary
+ right id), finds each word's pair of lowest rank, and merges all its occurrences from the left; only pairs beside a
merge are looked up again. Words without a known pair leave the rounds. The table of pieces is bounded.

A long text is encoded in runs that end where a piece certainly begins, so memory doesn't follow its length.

Null or empty text: no ids, decoded as the empty text. Special tokens inside a text become their own ids, as the library
has it by default. Rows, repeated ones too, and
columns besides the text pass unchanged; a column with the name asked for the ids or the decoded text is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlake.llm.shared import BLOCK, byte_hashes, slices, texts

NONE = np.iinfo(np.int32).max


def byte_symbols() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies have for each byte: itself if printable, else from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for bit, ranges in ((SOLID, ((33, 126), (0xC3, 0xCB))), (ALNUM, ((48, 57), (65, 90), (97, 122))), (PUNCT, ((33, 47), (58, 64), (91, 96), (123, 126))), (TAIL, ((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))), (LEAD, ((0xC3, 0xC3),)), (SPACE, ((32, 32),)), (LINE, ((10, 10),)), (ALPHA, ((65, 90), (97, 122)))):
        for low, high in ranges:
            out[low : high + 1] |= bit
    return out


#: Classes of bytes: SOLID begins a character that is certainly no white space (printable ASCII, lead bytes of Latin
#: letters); TAIL follows the byte LEAD in letters (all but the signs for times and divided by).
SOLID, ALNUM, PUNCT, TAIL, LEAD, SPACE, LINE, ALPHA = (1 << k for k in range(8))
CLASSES = _byte_classes()
SPACE_SOLID = re.compile(b" [\x21-\x7e\xc3-\xcb]")


class Bpe:
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    MOST_PIECES = 600_000

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile(b"|".join(map(re.escape, self.special))) if self.special else None
        self.longest = max(map(len, self.special), default=0)
        self.split = regex.compile(self.PATTERN)
        symbols = byte_symbols()
        of_symbol = {c: b for b, c in symbols.items()}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs] + [np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.where(order == len(pairs), NONE, order).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token
        self.dtype = np.dtype("<u4" if self.size > 65536 else "<u2")
        self.reset()

    def reset(self) -> None:
        """Forget all pieces."""
        self.hashes = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, given as their bytes in a row and their lengths, and the number of ids of each."""
        symbols = self.byte_id[raw]
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inner] = self.rank_of(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(symbols)))
            each = np.repeat(best, counts)
            over = each == NONE
            if over.any():
                done.append((owner[over], symbols[over]))
                keep = ~over
                symbols, owner, rank, each = symbols[keep], owner[keep], rank[keep], each[keep]
            hit = np.flatnonzero(rank == each)
            if not len(hit):
                break
            # of hits that follow each other (the same symbol three times) every second one is taken, from the left
            run = np.concatenate([[True], np.diff(hit) != 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at = hit - np.arange(len(hit))
            beside = np.zeros(len(symbols), bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            near = np.flatnonzero(beside)
            rank[near] = NONE
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.rank_of(symbols[near], symbols[near + 1])
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int32)
        symbols = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int32)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))

    def learn(self, raw: np.ndarray, whole: bytes, starts: np.ndarray, stops: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces in a row, and the number of ids of each. odd: pieces that the pattern may cut further."""
        lengths = stops - starts
        parts = np.ones(len(starts), np.int64)
        which = np.flatnonzero(~odd)
        own = lengths[which]
        at = np.repeat(starts[which] - np.cumsum(own) + own, own) + np.arange(own.sum())
        words: list[bytes] = []
        fixed = {}
        for k in np.flatnonzero(odd).tolist():
            piece = whole[starts[k] : stops[k]]
            if piece in self.special:
                fixed[len(words)] = self.special[piece]
                words.append(b" ")
            else:
                found = self.split.findall(piece.decode("utf-8", "replace"))
                parts[k] = len(found)
                words.extend(w.encode() for w in found)
        ids, counts = self.merge(np.concatenate([raw[at], np.frombuffer(b"".join(words), np.uint8)]), np.concatenate([own, np.fromiter(map(len, words), np.int64, len(words))]))
        if fixed:
            ids[(np.cumsum(counts) - counts)[len(own) + np.array(list(fixed))]] = list(fixed.values())
        # words stand in the order: whole pieces, then the parts of odd ones; back to the order of the pieces
        total = np.zeros(len(starts), np.int64)
        first = np.zeros(len(starts), np.int64)
        begin = np.concatenate([[0], np.cumsum(counts)])
        total[which], first[which] = counts[: len(own)], begin[: len(own)]
        other = np.flatnonzero(odd)
        edges = len(own) + np.concatenate([[0], np.cumsum(parts[other])])
        total[other], first[other] = np.diff(begin[edges]), begin[edges[:-1]]
        ends = np.cumsum(total)
        return ids[np.repeat(first - ends + total, total) + np.arange(len(ids))], total

    def cuts(self, raw: np.ndarray, kind: np.ndarray, begins: np.ndarray, whole: bytes) -> np.ndarray:
        """Where pieces begin: at every document, and where the pattern must begin a new part."""
        n = len(raw)
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        behind = np.zeros(n, np.uint8)
        behind[2:] = kind[:-2]
        letter = (before & ALNUM) | ((behind & LEAD) != 0) & ((before & TAIL) != 0)
        new = ((kind & PUNCT) != 0) & (letter != 0)
        new |= ((kind & LINE) != 0) & ((letter | (before & PUNCT)) != 0)
        space = np.zeros(n, bool)
        space[:-1] = ((kind[:-1] & SPACE) != 0) & ((kind[1:] & SOLID) != 0)
        space[begins[1:][begins[1:] > 0] - 1] = False
        new |= space
        new |= ((before & LINE) != 0) & ((behind & (PUNCT | ALNUM)) != 0) & ((kind & SOLID) != 0)
        new[begins[begins < n]] = True
        if self.find_special is not None:
            inner = begins[(begins > 0) & (begins < n)]
            for hit in self.find_special.finditer(whole):
                a, b = hit.span()
                if np.searchsorted(inner, a, side="right") == np.searchsorted(inner, b, side="left"):
                    new[a + 1 : b] = False
                    new[a] = True
                    new[b : b + 1] = True
        return np.flatnonzero(new)

    def parts(self, text: bytes) -> Iterator[bytes]:
        """A text in runs of about BLOCK bytes, cut where a piece certainly begins: at a space before a solid character.

        A special token that holds such a place isn't cut. A run without one stays whole.
        """
        start = 0
        while len(text) - start > 2 * BLOCK:
            at = start + BLOCK
            while True:
                hit = SPACE_SOLID.search(text, at)
                at = hit.start() if hit else len(text)
                around = self.find_special.finditer(text, max(start, at - self.longest), at + self.longest) if self.find_special else ()
                if not any(x.start() < at < x.end() for x in around):
                    break
                at += 1
            if at >= len(text):
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def encode_batch(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text; a step handles about BLOCK bytes or one run."""
        ids, counts = [np.zeros(0, self.dtype)], np.zeros(len(batch), np.int64)
        held: list[bytes] = []
        owner: list[int] = []
        size = 0
        for k, text in enumerate(batch):
            for part in self.parts(text.encode()):
                if held and size + len(part) > 2 * BLOCK:
                    size = self._flush(held, owner, ids, counts)
                held.append(part)
                owner.append(k)
                size += len(part)
        self._flush(held, owner, ids, counts)
        return np.concatenate(ids), counts

    def _flush(self, held: list[bytes], owner: list[int], ids: list[np.ndarray], counts: np.ndarray) -> int:
        found, n = self.encode_block(held)
        ids.append(found)
        np.add.at(counts, owner, n)
        held.clear()
        owner.clear()
        return 0

    def encode_block(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the runs of bytes in a row, and the number of ids of each run."""
        whole = b"".join(coded)
        if not whole:
            return np.zeros(0, self.dtype), np.zeros(len(coded), np.int64)
        if len(self.lengths) > self.MOST_PIECES:
            self.reset()
        raw = np.frombuffer(whole, np.uint8)
        begins = np.cumsum([0, *map(len, coded[:-1])])
        kind = CLASSES[raw]
        starts = self.cuts(raw, kind, begins, whole)
        stops = np.append(starts[1:], len(raw))
        halves = byte_hashes(raw, starts, stops)
        distinct, first, inverse = np.unique(halves[0].astype(np.uint64) << np.uint64(31) | halves[1].astype(np.uint64), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        which = np.zeros(len(distinct), np.int64)
        which[known] = self.entry[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[first[new]], stops[first[new]]
            letter = (kind & (ALPHA | LEAD)) != 0
            letter[1:] |= ((kind[1:] & TAIL) != 0) & ((kind[:-1] & LEAD) != 0)
            letter[:-1] &= ~(((kind[:-1] & LEAD) != 0) & ((kind[1:] & TAIL) == 0))
            other = np.concatenate([[0], np.cumsum(~letter, dtype=np.int32)])
            lead = (raw[a] == 32) & (b - a > 1)
            odd = other[b] > other[a + lead]
            ids, counts = self.learn(raw, whole, a, b, odd)
            which[new] = len(self.lengths) + np.arange(len(new))
            self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.flat = np.concatenate([self.flat, ids.astype(self.dtype)])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.entry = np.insert(self.entry, at[new], which[new])
        piece = which[inverse]
        lengths = self.lengths[piece]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.offsets[piece] - ends + lengths, lengths) + np.arange(int(ends[-1]))]
        # the pieces of a text are those that begin in it
        upto = np.searchsorted(starts, np.append(begins, len(raw)))
        counts = np.diff(np.concatenate([[0], ends])[upto])
        return ids, counts

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are no UTF-8 become the replacement character."""
        if not hasattr(self, "byte_lengths"):
            self.byte_lengths = np.array([len(b) for b in self.bytes_of], np.int64)
            self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
            self.byte_offsets = np.cumsum(self.byte_lengths) - self.byte_lengths
        raw, size = [], [np.zeros(1, np.int64)]
        for k in range(0, len(ids), BLOCK):
            own = ids[k : k + BLOCK]
            lengths = self.byte_lengths[own]
            ends = np.cumsum(lengths)
            raw.append(self.flat_bytes[np.repeat(self.byte_offsets[own] - ends + lengths, lengths) + np.arange(int(ends[-1]))].tobytes())
            size.append(ends + size[-1][-1])
        whole = b"".join(raw)
        at = np.concatenate(size)[np.concatenate([[0], np.cumsum(counts)])]
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=1)
def loaded(path: str) -> Bpe:
    """The tokenizer of a file, read once a Python worker."""
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The rows with the ids of their texts, and where a name is given, with the texts decoded from those ids."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in (ids, decoded)], T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    keep = [f.name for f in df.schema.fields if f.name not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch, text):
                flat, counts = bpe.encode_batch(texts(part, text))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
                more = [lists] + ([pa.array(bpe.decode_batch(flat, counts), pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(name)) for name in keep] + more, names=[f.name for f in schema.fields])

    return df.select(*keep).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the texts of their ids; null ids: the empty text."""
    keep = [f.name for f in df.schema.fields if f.name != text]
    schema = T.StructType([*[f for f in df.schema.fields if f.name != text], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            lists = [x or [] for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            flat = np.array([i for x in lists for i in x], np.int64)
            out = bpe.decode_batch(flat, np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[f.name for f in schema.fields])

    return df.select(*keep).mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    """Counts and digests of the columns ids and decoded."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

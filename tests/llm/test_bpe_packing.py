import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import queries as Q
from ledgerlake.llm.bpe import Bpe, decode, encode
from ledgerlake.llm.packing import crc_of, halves, pack, schedule

ODD = ["", None, "   ", "a  ", "b", "a  b\n \n c", "aaaaaaa", "don't 's  \n\n\n  x", "<|endoftext|>a<|endoftext|>", " <|endoftext|> \n<|endoftext|>\n", "<|endo", "ftext|>", "  　x y​z \x1c q", "日本語 텍스트 😀😀 ñ", "x" * 5000, " lead", "trail ", "a\r\nb\tc  ", "é.\nÈ ×, ÷! a—,b", "\nx", "\n", "x\n", "\n\nA", "a", "a"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer())


def test_encoder_equals_the_library(reference):
    rng = np.random.default_rng(0)
    alphabet = list("ab Z'.,\n\té×1<|>endoftx  \u0085 İ٣")
    batch = [x or "" for x in ODD] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]
    bpe = Bpe(Q.tokenizer())
    for _ in range(2):  # the second time from the table
        ids, counts = bpe.encode_batch(batch)
        at = np.concatenate([[0], np.cumsum(counts)])
        want = [x.ids for x in reference.encode_batch(batch, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
        assert bpe.decode_batch(ids, counts) == [reference.decode(x, skip_special_tokens=False) for x in want]


def test_encode_frames(spark, reference):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = encode(df, Q.tokenizer(), decoded="decoded").collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {k: reference.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(ODD)}
    assert {r.doc_id: r.decoded for r in rows} == {k: t or "" for k, t in enumerate(ODD)}
    again = decode(encode(df, Q.tokenizer()), Q.tokenizer(), text="back").collect()
    assert {r.doc_id: r.back for r in again} == {k: t or "" for k, t in enumerate(ODD)}
    assert encode(df.filter("false"), Q.tokenizer()).count() == 0


def check_packs(rows, documents, reference):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in documents.items():
        ids = reference.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        n = sum(r.length for r in own)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0


def test_packing_keeps_every_id_once(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_packs(Q.op1_packing(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()}, reference)


def test_packing_of_odd_rows(spark, reference):
    df = spark.createDataFrame([(k, t, [None, "a", "b"][k % 3], 1) for k, t in enumerate(ODD)], "doc_id long, text string, source string, pack long")
    check_packs(crc_of(pack(df, Q.tokenizer(), pack_tokens=300)).collect(), dict(enumerate(ODD)), reference)
    check_packs(crc_of(pack(df, Q.tokenizer(), shares={"a": 0.9}, pack_tokens=300)).collect(), dict(enumerate(ODD)), reference)
    assert pack(df.filter("false"), Q.tokenizer()).count() == 0


def test_windows_hold_the_mixture():
    from collections import deque

    rng = np.random.default_rng(1)
    queues = {s: deque((f"{s}{k}", int(n)) for k, n in enumerate(rng.integers(50, 3000, 400))) for s in "abc"}
    share = {"a": 0.6, "b": 0.3, "c": 0.1}
    windows = schedule({s: deque(q) for s, q in queues.items()}, share, {}, 2048, 256)
    taken, total = dict.fromkeys("abc", 0), 0
    for pieces in windows[:300]:
        assert sum(p[2] for p in pieces) == 2048
        for doc, _, n in pieces:
            taken[doc[0]] += n
            total += n
        for s in "abc":
            assert abs(taken[s] - share[s] * total) < 2048
    assert sum(p[2] for w in windows for p in w) == sum(n for q in queues.values() for _, n in q)
    assert [sum(p[2] for p in x) for x in halves([("d", 0, 1300)], 2048)] == [1024, 256, 16, 4]


def test_deficits_are_carried_across_packs(spark, sf):
    """What a pack owes its sources is paid in the packs after it: over all packs in order, the distance of a source's
    ids from its share of all ids never grows while every queue has ids, but for two windows, and what is owed shrinks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    rows = pack(docs, Q.tokenizer(), pack_tokens=20_000).select("source", "length", "sequence_id", "offset").collect()
    packs = sorted({r.sequence_id >> 32 for r in rows})
    assert len(packs) > 3
    total = sum(r.length for r in rows)
    share = {s: sum(r.length for r in rows if r.source == s) / total for s in "xy"}
    taken, seen, paid = {"x": 0, "y": 0}, 0, 0
    for p in packs:
        own = sorted((r.sequence_id, r.offset, r.source, r.length) for r in rows if r.sequence_id >> 32 == p)
        left = {s: sum(r[3] for r in own if r[2] == s) for s in "xy"}
        owed = {s: share[s] * seen - taken[s] for s in "xy"}
        first = dict.fromkeys("xy", 0)
        for _, _, source, n in own:
            taken[source] += n
            left[source] -= n
            seen += n
            if not all(left.values()):
                break
            assert all(abs(taken[s] - share[s] * seen) <= max(abs(owed[s]), 2048) + 2 * 2048 for s in "xy")
            first[source] += n
        if max(owed.values()) > 2048 and sum(first.values()) > 2 * 2048:
            late = max(owed, key=owed.get)
            assert first[late] > share[late] * sum(first.values())
            paid += 1
        for s in "xy":
            taken[s] += left[s] if not all(left.values()) else 0
        seen = sum(taken.values())
    assert paid


def test_long_texts_in_bounded_memory(reference):
    """A text far longer than a block is encoded in runs, with the library's ids."""
    rng = np.random.default_rng(3)
    words = ["the", "Größe", "don't", "x1", " ", "\n", "<|endoftext|>", "日本", "a.b,c"]
    text = " ".join(rng.choice(words, 400_000))
    bpe = Bpe(Q.tokenizer())
    assert len(list(bpe.parts(text.encode()))) > 4
    ids, counts = bpe.encode_batch([text, "", "y" * 3_000, text[:50]])
    want = [x.ids for x in reference.encode_batch([text, "", "y" * 3_000, text[:50]], add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))
    assert bpe.decode_batch(ids, counts)[0] == text

import hashlib
import json
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import queries as Q
from ledgerlake.llm.chat import digests, escape, formatted, spans, unescape
from ledgerlake.llm.classifier import classify
from ledgerlake.llm.embeddings import near_duplicates
from ledgerlake.llm import classifier, maxent, simhash, urls
from ledgerlake.llm.maxent import score
from ledgerlake.llm.rules import judge as judge_rules
from ledgerlake.llm.shared import Deal, connected_components, local_components, window_hashes
from ledgerlake.llm.simhash import anchors, components, family_links, fingerprints_of, links_within, near_copies, near_links
from ledgerlake.llm.substring import remove_repeats
from ledgerlake.llm.urls import judge as judge_urls

LONG = " ".join(f"w{k}" for k in range(120))
ODD = [None, "", " \n\t ", "a", "a", "b c", LONG, LONG + " tail words here", "x y " * 400, "é ü ñ " * 30, "# $ % " * 60, "y" * 100_000]


def odd_docs(spark, n_extra=0):
    rows = [(k, t, "en", None if k % 3 == 0 else f"s{k % 2}", 1, "clash") for k, t in enumerate(ODD)]
    rows += [(None, "no id", "en", "s1", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk string")


def odd_labels(spark):
    return spark.createDataFrame([(3, 1, 0), (6, 1, 0), (6, 1, 0), (10, 0, 0), (None, 0, 0), (8, None, 0), (9, 1, 1), (7, 5, 0)], "doc_id long, quality int, toxic int")


def words_of(text):
    return (text or "").encode().split()


def brute_repeats(docs, size):
    seen = Counter()
    for text in docs.values():
        w = words_of(text)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = {}
    for k, text in docs.items():
        w = words_of(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out[k] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_window_hashes_over_blocks():
    rng = np.random.default_rng(0)
    docs = [[b"w%d" % i for i in rng.integers(0, 9, n)] for n in (0, 3, 5, 400, 90)]
    for block in (40, 1_000_000):
        hashes, counts = window_hashes(docs, 5, block)
        want = [tuple(d[i : i + 5]) for d in docs for i in range(len(d) - 4)]
        assert counts.tolist() == [max(0, len(d) - 4) for d in docs] and len(hashes) == len(want)
        assert len(set(zip(hashes.tolist(), want))) == len(set(want)) == len(set(hashes.tolist()))
        again, _, dealt = window_hashes(docs, 5, block, dealt=True)
        assert (again == hashes).all() and len(set(zip(dealt.tolist(), want))) == len(set(want)) == len(set(dealt.tolist()))


def test_substring_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op3_substring_dedup(spark, sf).collect()}
    assert got == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in brute_repeats(docs, 35).items()}


def test_substring_odd_rows(spark):
    df = odd_docs(spark)
    got = {r.doc_id: (r.n_words, sum(s.stop - s.start for s in r.spans), r.kept) for r in remove_repeats(df).collect()}
    assert got == brute_repeats(dict(enumerate(ODD)) | {None: "no id"}, 35)
    assert remove_repeats(df.filter("false")).count() == 0


def test_substring_in_two_levels(spark, sf):
    """Any way to deal the hashes gives the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    want = {r.doc_id: r.kept for r in remove_repeats(docs).collect()}
    for deal in (Deal(5), Deal(3, 4, 1), Deal(4, 3, 2)):
        assert {r.doc_id: r.kept for r in remove_repeats(docs, deal=deal).collect()} == want


def test_rows_sent_grow_with_the_input():
    """Rows between chunks and buckets, at both levels, for 1, 4, and 16 times an input of two levels."""
    rng = np.random.default_rng(6)
    per_chunk = 400_000
    keys, dealt = np.sort(rng.integers(0, 1 << 62, per_chunk, dtype=np.uint64)), rng.integers(0, (1 << 31) - 61, per_chunk)

    def sent(chunks):
        deal = Deal.of(chunks * per_chunk, 200)
        assert deal.finer > 1
        per_node = min(deal.finer, deal.group * per_chunk // deal.slots)
        return chunks * deal.blobs(0, keys, dealt).num_rows + chunks / deal.group * deal.slots * per_node

    one, four, sixteen = (sent(x) for x in (1_000_000, 4_000_000, 16_000_000))
    assert four <= 4.4 * one and sixteen <= 4.4 * four


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}
    label = local_components(1100, np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert all(label[x] == find(x) for x in parent)


def test_components_of_long_chains(spark):
    """Chains of more hops than any fixed number of rounds: in random order, and 1, n, n-1, .. 2, whose ends are both low."""
    mixed = (5_000 + np.random.default_rng(11).permutation(2_000)).tolist()
    adverse = [1, *range(1_500, 1, -1)]
    links = [x for chain in (mixed, adverse) for x in zip(chain, chain[1:])]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: min(chain) for chain in (mixed, adverse) for x in chain}


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(docs):
    fps = {k: brute_fingerprint(t) for k, t in docs.items()}
    keys = sorted(fps)
    comp = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[a] < comp[b]:
                    comp[b] = comp[a]
                    changed = True
    return {k: (f"{fps[k]:016x}", comp[k]) for k in keys}


def test_anchors_cover():
    values = np.random.default_rng(1).integers(0, 1 << 31, 300, dtype=np.uint64)
    which, found = anchors(values, 31)
    assert (np.bitwise_count(values[which] ^ found) <= 2).all() and np.bincount(which).min() >= 1 and np.bincount(which).max() <= 16
    near = values ^ (np.uint64(1) << np.random.default_rng(2).integers(0, 31, 300).astype(np.uint64))
    other, also = anchors(near, 31)
    for k in range(300):
        assert set(found[which == k].tolist()) & set(also[other == k].tolist())


def test_simhash_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op5_simhash(spark, sf).collect()}
    assert got == brute_simhash(docs)


def test_simhash_odd_rows(spark):
    got = components(odd_docs(spark)).collect()
    want = brute_simhash(dict(enumerate(ODD)))
    assert {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in got if r.doc_id is not None} == want
    assert components(odd_docs(spark).filter("false")).count() == 0


@pytest.mark.parametrize("hot", [30_000, 40, 4])
def test_simhash_links_lose_none(spark, hot):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = [sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))}) for _ in range(1200)]
    fps = np.unique(np.array([int(centres[k % 20]) ^ flip for k, flip in enumerate(flips)], np.uint64))
    signed = fps.view(np.int64).tolist()
    nodes = spark.createDataFrame([(int(f),) for f in signed], "fp long")
    got = {r.node: r.component for r in connected_components(near_links(nodes, hot=hot)).collect()}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    label = local_components(len(fps), i, j)
    assert [got.get(f, f) for f in signed] == [min(signed[j] for j in np.flatnonzero(label == k)) for k in label]
    a, b = links_within(np.zeros(len(fps), np.uint64), fps, 3)
    assert (local_components(len(fps), a, b) == label).all()


def brute_near(docs, similarity=0.8, size=5):
    """Smallest id of each document's group; groups are linked by the Jaccard similarity of sets of shingles."""
    words = {k: (t or "").encode().lower().split() for k, t in docs.items()}
    sets = {k: {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)} for k, w in words.items()}
    keys = sorted(sets)
    pairs = [(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys[:i]) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    label = local_components(len(keys), np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64))
    return {k: keys[label[i]] for i, k in enumerate(keys)}


def test_near_copies_equal_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = sorted(t for t in docs.values() if t and len(t.split()) >= 300)[:20]
    for k, text in enumerate(words):  # planted: one word in 60 changed, from different words on; and one in 15, which is too many
        own = text.split()
        for n, step in enumerate((60, 60, 15)):
            docs[10_000 + 3 * k + n] = " ".join(f"changed{n}{i}" if i % step == 7 * n + 5 else w for i, w in enumerate(own))
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, root string")
    got = {r.doc_id: r.component_id for r in near_copies(frame).collect()}
    assert got == brute_near(docs)


def test_near_copies_odd_rows(spark):
    got = near_copies(odd_docs(spark)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_near(dict(enumerate(ODD)))
    assert near_copies(odd_docs(spark).filter("false")).count() == 0


@pytest.mark.parametrize("hot", [30_000, 60, 4])
def test_families_of_crowded_anchors(spark, hot):
    """Families of up to 300 fingerprints within a few bits, one bit of which none shares: none is lost, none is far."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, (6, 3), dtype=np.uint64)
    rows = [(k, *(int(centres[k % 6, w]) ^ sum({1 << int(b) for b in rng.integers(0, 62, 2)}) for w in (0, 1, 2))) for k in range(600 if hot == 4 else 1800)]
    nodes = spark.createDataFrame([(k, *np.array(own, np.uint64).view(np.int64).tolist()) for k, *own in rows], "node long, a long, b long, c long")
    links = family_links(nodes, hot=hot).collect()
    assert all(r.src < r.dst and r.src % 6 == r.dst % 6 for r in links)
    label = local_components(len(rows), np.array([r.src for r in links]), np.array([r.dst for r in links]))
    assert label.tolist() == [k % 6 for k in range(len(rows))]


def test_links_within_connect_as_all_pairs_do():
    rng = np.random.default_rng(9)
    for n, kinds, distance in ((200, 9, 8), (900, 2, 12), (3000, 1, 10)):
        fps = (rng.integers(0, 4, (n, 2)) * rng.integers(0, 2, (n, 2))).astype(np.uint64) * np.uint64(0x0101010101010101) ^ rng.integers(0, 1 << 6, (n, 2)).astype(np.uint64)
        keys = rng.integers(0, kinds, n).astype(np.uint64)
        a, b = links_within(keys, fps, distance)
        assert (keys[a] == keys[b]).all() and len(a) < max(64, n) * 64
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(2, dtype=int)
        i, j = np.nonzero((keys[:, None] == keys[None, :]) & (apart <= distance))
        assert (local_components(n, a, b) == local_components(n, i, j)).all()


@pytest.mark.parametrize("block_bytes", [4_000_000, 60_000])
def test_near_copies_of_form_letters_lose_none(spark, monkeypatch, block_bytes):
    """Texts that share most of a form letter, alike and unlike mixed, each with a copy that differs in one word, in crowded anchors."""
    monkeypatch.setattr(simhash, "alike_links", lambda *a, f=simhash.alike_links: f(*a, block_bytes=block_bytes))
    rng = np.random.default_rng(15)
    letter = [f"w{x}" for x in rng.integers(0, 400, 120)]
    docs = {}
    for k in range(260):
        own = list(letter)
        for at in rng.choice(120, rng.integers(2, 12), replace=False):
            own[at] = f"x{rng.integers(0, 10**6)}"
        docs[2 * k] = " ".join(own)
        own[int(rng.integers(0, 120))] = "one"
        docs[2 * k + 1] = " ".join(own)
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = brute_near(docs)
    assert got == want and 20 < len(set(want.values())) < 260
    sets = [np.unique(np.array([hash(" ".join(w[i : i + 5])) % 2**31 for i in range(len(w) - 4)], np.int32)) for w in (docs[k].split() for k in range(100))]
    a, b = simhash.alike_within(np.zeros((100, 3), np.uint64), sets, np.arange(100) % 2, 30, 0.8)
    both = [(i, j) for i in range(0, 100, 2) for j in range(1, 100, 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert (local_components(100, a, b) == local_components(100, np.array([i for i, _ in both]), np.array([j for _, j in both]))).all()


def brute_rules(text):
    w = [x.decode() for x in words_of(text)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + d for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_rules(spark, sf):
    rows = {r.doc_id: r for r in Q.op4_quality_rules(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for k, r in rows.items()} == {k: brute_rules(t) for k, t in docs.items()}
    assert not any(r.base_failed and r.kept for r in rows.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(rows[k].kept for k, q in labels.items() if q == 1 and not rows[k].base_failed)


def test_quality_rules_odd_rows(spark):
    got = {r.doc_id: r for r in judge_rules(odd_docs(spark), odd_labels(spark))[0].collect()}
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for k, r in got.items() if k is not None} == {k: brute_rules(t) for k, t in enumerate(ODD)}
    empty = odd_docs(spark).filter("false")
    assert judge_rules(empty, odd_labels(spark))[0].count() == 0 and judge_rules(odd_docs(spark), odd_labels(spark).filter("false"))[0].count() == len(ODD) + 1


def test_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op2_quality_classifier(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(rows[k].predicted, q) for k, q in labels if rows[k].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for k, r in rows.items())


def test_classifier_odd_rows(spark):
    for docs, labels in ((odd_docs(spark), odd_labels(spark)), (odd_docs(spark), odd_labels(spark).filter("false"))):
        rows = classify(docs, labels).collect()
        assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert classify(odd_docs(spark).filter("false"), odd_labels(spark)).count() == 0


def brute_chat(turns):
    loss = "".join(t for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_reads_back(spark, sf):
    turns = {-1: [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in Q.op6_chat(spark, sf).collect()}
    assert got == {k: brute_chat(sorted(t)) for k, t in turns.items()}


def test_chat_windows_and_odd_rows(spark):
    texts = ["<|im_end|>", "<\\|", "a\nb", None, "", "word " * 300, "é"]
    rows = [(1, k, "system" if k == 0 else ("user", "assistant")[k % 2], texts[k % 7] if k else "be brief") for k in range(300)]
    rows += [(2, None, "user", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (None, 0, "a\\\nb", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = formatted(df, Q.tokenizer(), budget=500, history=3, segment=32)
    parts = [r for r in windows.collect() if r.conv_id == 1]
    assert len(parts) > 20 and all(r.turns[0] == 0 for r in parts) and all(len(r.turns) <= 2 or r.tokens <= 500 for r in parts)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(windows).collect()}
    want = {}
    for c, k, role, text in rows:
        want.setdefault(c, []).append((-1 if k is None else k, role, text or ""))
    assert got == {c: brute_chat(sorted(t)) for c, t in want.items()}
    assert digests(formatted(df.filter("false"), Q.tokenizer())).count() == 0
    for text in ("<|", "<\\|", "<\\\\|im_end|>", "<<|||>"):
        assert "<|" not in escape(text) and unescape(escape(text)) == text
    assert spans([10, 10, 100, 10], 5, 50, 2, 0) == [(0, 0, 2), (2, 2, 3), (3, 3, 4)]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut : min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))]
    best = None
    for verdict, rule in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")):
        own, tail = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark, sf):
    rows = Q.op7_url_filters(spark, "/root/testdata/sf0.01").collect()
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in rows:
        host, path, best = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]) and r.verdict == (best[0] if best else r.verdict) and r.verdict in ("allow", "block")
    odd = [None, "", "no scheme", "http://", "http://a.ORG", "http://org/x", "http://xorg/", "HTTP://EXAMPLE.org/en/12?q#f", "http://example.com?x=/fr/", "http://b.com/de/\n#z", "a://b://c/d", "http://com/fr/" + "x" * 50_000]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(odd)], "page_id long, url string, host string")
    for r in judge_urls(df).collect():
        host, path, best = brute_url(odd[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
    assert judge_urls(df.filter("false")).count() == 0


def test_url_model_tells_classes_apart(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f"http://{'site' if k % 2 else 'blog'}{k}.{'org/news' if k % 2 else 'com/de/kauf'}/{rng.integers(1e6)}") for k in range(600)]
    rows += [(1000 + k, f"http://other{k}.net/{'news' if k % 2 else 'de/kauf'}/{rng.integers(1e6)}") for k in range(100)]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + k] == ("allow" if k % 2 else "block") for k in range(100)) > 90


def brute_ratio(url, allowed, blocked, strength=2.0):
    """Mean log ratio of a URL's bytes under models counted from two lists of URLs, byte by byte."""
    total = 0.0
    for sign, urls in ((1, allowed), (-1, blocked)):
        joint, alone = Counter(), Counter()
        for u in urls:
            raw = b"\x02" * 5 + u.encode() + b"\x03"
            for i in range(5, len(raw)):
                for order in range(5):
                    joint[raw[i - order : i + 1]] += 1
                    alone[order, raw[i - order : i]] += 1
        raw = b"\x02" * 5 + url.encode() + b"\x03"
        for i in range(5, len(raw)):
            p = 1 / 256
            for order in range(5):
                p = (joint[raw[i - order : i + 1]] + strength * p) / (alone[order, raw[i - order : i]] + strength)
            total += sign * np.log(p)
    return total / (len(url.encode()) + 1)


def test_url_model_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    make = lambda n: ["".join(rng.choice(list("abc/.é1"), rng.integers(0, 30))) for _ in range(n)]
    allowed, blocked = make(60), make(50)
    rows = spark.createDataFrame([(True, u) for u in allowed] + [(False, u) for u in blocked], "allowed boolean, url string")
    counts = urls.counted(rows)
    model = urls.fitted(counts)
    asked = [*allowed[:10], *make(20), "", "zz"]
    assert np.allclose(model.log_ratio(asked), [brute_ratio(u, allowed, blocked) for u in asked])
    small = urls.fitted(counts, most=200)
    assert 0 < len(small.keys) < len(model.keys)
    for m in (model, small, urls.Markov(np.zeros(0, np.int64), np.zeros((2, 0)))):
        for context in (b"\x02\x02\x02\x02", b"abca", b"//.1", b"zzzz"):
            number = lambda order: sum(c << 8 * k for k, c in enumerate(reversed(context[4 - order :])))
            keys = np.array([[order << 40 | number(order) << 8 | b for b in range(256)] for order in range(5)])
            assert np.allclose(m.probabilities(keys).sum(1), 1)


def brute_discriminant(rows, x, shrink=0.1, ridge=1e-3):
    """P(class 1) from the definition: densities of shrunk covariances, with determinants and solved systems."""
    data = {k: np.array([f for f, q in rows if q == k]) for k in (0, 1)}
    n = sum(map(len, data.values()))
    size = len(x)
    pooled = sum(((d - d.mean(0)) ** 2).sum(0) for d in data.values()) / n
    logs = []
    for d in data.values():
        weight = shrink + (1 - shrink) * size / (size + len(d))
        cov = (1 - weight) * np.cov(d.T, bias=True) + weight * np.diag(np.maximum(pooled, ridge)) + ridge * np.eye(size)
        off = x - d.mean(0)
        logs.append(np.log(len(d) / n) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * off @ np.linalg.solve(cov, off))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_classifier_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    train = [(np.array(classifier.statistics(texts[k])), q) for k, q in labels.items() if k in texts and zlib.crc32(str(k).encode()) % 5]
    got = {r.doc_id: r.score for r in Q.op2_quality_classifier(spark, sf).collect()}
    for k in sorted(texts)[:200]:
        assert abs(got[k] - brute_discriminant(train, np.array(classifier.statistics(texts[k])))) < 1e-6


def test_rules_are_the_learned_list(spark):
    """Every verdict is that of the list, read as plain conditions over the same statistics."""
    sf = "/root/testdata/sf0.01"
    judged, rules = judge_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for r in judged.collect():
        hit = any(all((r[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not hit)
    assert rules


def test_lm_scoring(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op8_lm_scoring(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in docs.items()}
    c = Counter(x for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 10 for x in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert abs(r.base_score - sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) < 1e-6 * abs(r.base_score)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in rows)


def brute_lm(tokens, paths, weights, counts):
    """log10 of the model's probability of one text, a token at a time in plain Python, from the fitted parameters."""
    m64 = (1 << 64) - 1
    mix, stir = int(maxent.MIX), int(maxent.STIR)
    keys = [int(maxent.END_KEY) if t is None else int(maxent.keys_of(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
    ranks = {int(k): int(r) for k, r in zip(paths.keys, paths.ranks)}
    half, nodes = maxent.half(paths.levels), maxent.n_nodes(paths.levels)
    hashed = [(k ^ k >> 29) * stir & m64 for k in keys]
    shift = 64 - (len(weights) - nodes).bit_length() + 1
    total = 0.0
    for i, (key, token) in enumerate(zip(keys, tokens)):
        leaf = ranks.get(key)
        if leaf is None:
            leaf = half + ((key & 15) << (4 * paths.levels - 5) | (key >> 4) * stir % (1 << 64) >> 64 - (4 * paths.levels - 5))
            total += log10((counts[token] + 0.1) / (paths.tokens[leaf - half] + 0.1 * (paths.types[leaf - half] + 1)))
        before = [hashed[i - k] if i >= k else 1 for k in (1, 2, 3)]
        contexts = [(x + k + 1) * mix & m64 for k, x in enumerate(before)] + [before[0] * mix + before[1] * stir & m64]
        for level in range(paths.levels):
            node = (16**level - 1) // 15 + (leaf >> 4 * (paths.levels - level))
            salt = (node + 1) * mix & m64
            z = weights[node].astype(float) + sum(weights[nodes + ((c ^ salt) * stir % (1 << 64) >> shift)].astype(float) for c in contexts)
            total += (z[leaf >> 4 * (paths.levels - level - 1) & 15] - np.log(np.exp(z).sum())) / np.log(10)
    return total


@pytest.mark.parametrize("chunk_bytes", [1_500_000, 40_000])
def test_lm_score_equals_brute_force(spark, sf, chunk_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    c = Counter(x for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 10 for x in t)
    _, _, _, paths, weights = maxent.fitted(docs, chunk_bytes=chunk_bytes)
    assert weights.any() and paths.total == sum(c.values()) and paths.n_types == len(c)
    probabilities = maxent.exponentials(weights, np.random.default_rng(0).integers(0, len(weights), (5, 100)))
    assert np.allclose(probabilities[0].sum(1), probabilities[1], rtol=1e-5)
    for deal in (None, Deal(3, 4, 1 << 20)):
        rows = score(docs, chunk_bytes=chunk_bytes, deal=deal).collect()
        assert {r.doc_id: (r.n_tokens, r.n_known) for r in rows} == {k: (len(t), sum(c[x] > 0 for x in t)) for k, t in tokens.items()}
    by_id = {r.doc_id: r for r in score(docs, chunk_bytes=chunk_bytes).collect()}
    # the weights depend on the order of tasks' sums in their last bits alone
    for k in sorted(tokens)[:40]:
        assert abs(by_id[k].score - brute_lm(tokens[k], paths, weights, c)) < 1e-3 * len(tokens[k])


def test_lm_paths_share_all_probability():
    """Over all words of a vocabulary and one unseen, a context's probabilities sum to one."""
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(1, 1 << 62, 3000, dtype=np.uint64))
    counts = rng.integers(1, 50, len(keys))
    levels = 2
    top = np.argsort(-counts, kind="stable")[: maxent.half(levels)]
    leaves = maxent.leaf_of(keys, levels) - maxent.half(levels)
    paths = maxent.Paths(levels, keys[top], counts[top], np.bincount(leaves, counts, maxent.half(levels)), np.bincount(leaves, minlength=maxent.half(levels)), int(counts.sum()), len(keys))
    weights = rng.normal(size=(maxent.n_rows(levels), maxent.WIDTH)).astype(np.float32)
    own = paths.leaves(keys)
    rows, digits = maxent.examples_of(keys, own, np.arange(len(keys)), np.ones(len(keys), np.int64), levels)
    e, total = maxent.exponentials(weights, rows)
    logs = np.log10(e[np.arange(len(digits)), digits] / total).reshape(levels, -1).sum(0) + paths.inside(keys, own, counts)
    # every last class keeps 0.1 of a word for one that was never seen; classes without any word are all for such words
    classes = np.arange(2 * maxent.half(levels))
    path_keys = np.zeros(len(classes), np.uint64)
    rows, digits = maxent.examples_of(path_keys, classes, np.arange(len(classes)), np.ones(len(classes), np.int64), levels)
    e, total = maxent.exponentials(weights, rows)
    of_class = (e[np.arange(len(digits)), digits] / total).reshape(levels, -1).prod(0)
    unseen = of_class[maxent.half(levels) :] * 0.1 / (paths.tokens + 0.1 * (paths.types + 1))
    assert abs((10**logs).sum() + unseen.sum() - 1) < 1e-4


def test_lm_pieces_of_long_texts(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in rng.zipf(1.5, 30_000) % 500]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50])), (None, " ".join(words)), (13, "x" * 200_000)]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=20_000).collect()}
    assert got[1].n_tokens == got[None].n_tokens == 30_001 and got[2].n_tokens == 51 and got[13].n_tokens == 2
    whole = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in got:
        assert got[k].n_known == whole[k].n_known and abs(got[k].base_score - whole[k].base_score) < 1e-6 * abs(whole[k].base_score)
    text = b"aa bb ccc  dd\nee ff " * 30
    for most in (1, 5, 64, 10_000):
        parts = list(maxent.pieces_of(text, most))
        assert [w for x, skip in parts for w in x.split()[skip:]] == text.split()
        assert all(x.split()[:skip] == [w for y, n in parts[:k] for w in y.split()[n:]][-skip:] for k, (x, skip) in enumerate(parts) if skip)


def test_lm_odd_rows(spark):
    rows = score(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 1 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert score(odd_docs(spark).filter("false")).count() == 0


def brute_vectors(rows, cosine=0.95):
    ok = {}
    for k, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[k] = x / np.abs(x).max()
    links = {k: [j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] / (np.linalg.norm(ok[j]) * np.linalg.norm(ok[k])) >= cosine] if k in ok else [] for k, _ in rows}
    comp = {k: k for k, _ in rows}
    changed = True
    while changed:
        changed = False
        for k, own in links.items():
            low = min([comp[k], *[comp[j] for j in own]])
            changed |= low < comp[k]
            comp[k] = low
    return {k: (len(links[k]), comp[k], comp[k] == k) for k in links}


@pytest.mark.parametrize("run_rows", [8192, 150])
def test_embeddings_equal_brute_force(spark, run_rows):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(k, (base[k % 60] + rng.normal(size=16) * 0.12 * (k % 4)).tolist()) for k in range(700)]
    rows += [(k + 700, v) for k, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [None, 1.0], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1e300, 1e300], base[0].tolist(), base[0].tolist(), (2 * base[0]).tolist()])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, run_rows=run_rows).collect()}
    assert got == brute_vectors(rows)
    assert near_duplicates(df.filter("false")).count() == 0


def test_embeddings_without_ids_count(spark):
    """Vectors whose rows all lack an id are links of others and have links; they name no component."""
    turned = lambda a: [float(np.cos(a)), float(np.sin(a))]  # noqa: E731  0.3 apart is alike, 0.6 is not
    rows = [(5, turned(0.0)), (None, turned(0.3)), (7, turned(0.6)), (None, turned(2.0)), (None, turned(2.0)), (None, turned(2.2)), (9, turned(4.0))]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(5, 1, 5, True), (None, 2, 5, False), (7, 1, 5, False), (None, 2, None, False), (None, 2, None, False), (None, 2, None, False), (9, 0, 9, True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_embeddings_of_repeated_ids(spark):
    """Rows that share an id but not the vector have each its own links."""
    rng = np.random.default_rng(14)
    a, b = rng.normal(size=8), rng.normal(size=8)
    near = lambda v: (v + rng.normal(size=8) * 1e-3).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (3, near(a)), (4, near(b)), (5, near(b)), (None, near(a))]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in got)) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (3, 2, 1), (4, 2, 1), (5, 2, 1)]


def test_pipeline_keeps_one_of_each_text(spark, sf):
    """Rows that share a doc_id but not the text are linked and kept each for itself; copies stay once."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "uv")
    rows = [(3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "t", 1), (None, b, "en", "s", 1), (None, "w " * 60, "en", "s", 1), (None, "w " * 60, "en", "s", 1), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (None, "w " * 60), (8, None)], key=str)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = set(docs.columns)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_dedup", "substring_dedup", "packing"]
    kept = {k for k, t in texts.items() if not brute_rules(t)[-1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        assert set(docs.columns) == names
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids))
        if name == "quality rules":
            assert set(ids) <= kept
        if name == "SimHash near-dedup":
            assert set(ids) == set(brute_near({r.doc_id: r.text for r in before}).values())
        if name == "substring dedup":
            brute = brute_repeats({r.doc_id: r.text for r in before}, 35)
            was = {r.doc_id: r.text for r in before}
            assert {r.doc_id: r.text for r in rows} == {k: t if m else was[k] for k, (_, m, t) in brute.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.packing(spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_pipeline_classifier_judges_each_row(spark, sf):
    """A rejected text goes without a doc_id too, and alone where another text has the same doc_id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    named = {r.doc_id for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = {r.doc_id: r.predicted for r in classify(docs, labels).collect()}
    bad = min(k for k, p in judged.items() if not p)
    good = min(k for k, p in judged.items() if p and k not in named)
    more = [(None, texts[bad], "en", "s", 1), (None, texts[good], "en", "s", 1), (good, texts[bad], "en", "s", 1)]
    got = corpus_pipeline.quality_classifier(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), sf).collect()
    want = [(k, texts[k]) for k, p in judged.items() if p] + [(None, texts[good])]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_pipeline_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    odd_labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    odd_docs(spark).filter("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

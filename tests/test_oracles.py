"""Queries that SQL can't state, against plain Python versions over their whole tables."""

import hashlib
import html
import math
import re
from collections import Counter, defaultdict

import pytest

from ledgerlake import catalogue, queries as _  # noqa: F401
from ledgerlake.functions.udfs import LEAST_BODY, NEXT_ITEM, SECTIONS

SPACE = " \t\n\r\f\v"


def run(spark, sf, name):
    return catalogue.QUERIES[name](spark, sf).collect()


def rows_of(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_answer_pieces(spark, sf):
    want = {}
    for r in rows_of(spark, sf, "benchmark"):
        lines = [""]
        for word in (r.text or "").split():
            joined = f"{lines[-1]} {word}".strip()
            lines = [*lines[:-1], joined] if len(joined) <= 120 or not lines[-1] else [*lines, word]
        want |= {(r.item_id, k): line for k, line in enumerate(lines) if line}
    assert {(r.item_id, r.position): r.piece for r in run(spark, sf, "f28_st9_answer_pieces")} == want


def text_nodes(page, hide):
    """Text between tags by one pattern: comments, declarations and tags go, scripts and styles too if hidden."""
    parts = re.split(r"(?s)(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!?/?[a-zA-Z][^>]*>)", page)
    out = []
    for k, part in enumerate(parts):
        inner = re.fullmatch(r"(?s)<(script|style)\b[^>]*>(.*?)</\1\s*>", part) if k % 2 else None
        own = inner[2] if inner and not hide else "" if k % 2 else html.unescape(part)
        out += [own.strip()] if own.strip() else []
    return "\n".join(out)


def test_html_text(spark, sf):
    want = {r.page_id: (text_nodes(r.html, True), text_nodes(r.html, False)) for r in rows_of(spark, sf, "pages") if r.html is not None}
    got = {r.page_id: (r.text, r.all_text) for r in run(spark, sf, "s13_s14_html_text") if r.text is not None}
    assert got == want


def sections(text):
    """Every position is asked in turn whether a section begins there; its end is the next mark."""
    chosen = {}
    for key, (_, pattern) in SECTIONS.items():
        for m in re.finditer(pattern, text, re.IGNORECASE):
            rest = re.split(NEXT_ITEM, text[m.end() :], maxsplit=1, flags=re.IGNORECASE)[0]
            if key not in chosen or not chosen[key][1]:
                chosen[key] = (m.start(), len(m[0]) + len(rest) >= LEAST_BODY)
    out = []
    for key, (start, _) in sorted(chosen.items(), key=lambda x: x[1][0]):
        ends = [p for p, _ in chosen.values() if p > start] + [m.start() for m in re.finditer(NEXT_ITEM, text, re.IGNORECASE) if m.start() > start] + [len(text)]
        out.append((key, start, min(ends), hashlib.sha256(text[start : min(ends)].strip().encode()).hexdigest()))
    return out


def test_sections(spark, sf):
    from ledgerlake.functions.udfs import sections_of

    want = {r.page_id: sections(re.sub(r"[ \t\r\f\v]+", " ", text_nodes(r.html, True))) for r in rows_of(spark, sf, "pages") if r.html is not None}
    got = {r.page_id: [(s.section_key, s.start, s.stop, s.text_hash) for s in r.sections] for r in run(spark, sf, "s15_sections") if r.sections is not None}
    assert got == want
    filing = "Item 1. Business short. Item 1A. Risk Factors brief Item 2 x. " + "Item 1. Business " + "b " * 300 + "Item 1A. Risk Factors " + "r " * 400 + "Liquidity and capital resources l Item 7. Management's discussion and analysis m Item 8 strategy s"
    assert [(s["section_key"], s["start"], s["stop"], s["text_hash"]) for s in sections_of(filing)] == sections(filing) != []


def clean(text):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", text.replace("\0", " "))).strip()


def test_summaries(spark, sf):
    from ledgerlake.functions.text import SIGNALS

    def summary(text):
        own = clean(text)
        if len(own) <= 1200:
            return own
        parts = [s.strip(SPACE) for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", own.strip(SPACE)) if s.strip(SPACE)]
        signal = lambda s: re.search("|".join(SIGNALS), " ".join(re.findall("[a-z0-9]+", s.lower())))
        told = " ".join([*parts[:1], *[s for s in parts[1:] if signal(s)]][:5])
        if len(told) <= 1200:
            return told
        return (told[:1200].rsplit(" ", 1)[0] if " " in told[:1200] else told[:1200]).strip(SPACE)

    docs = {r.doc_id: summary(r.text) for r in rows_of(spark, sf, "documents") if r.text is not None}
    got = {r.doc_id: r.summary for r in run(spark, sf, "d7_summaries") if r.summary is not None}
    assert got == docs


def test_chunks(spark, sf):
    """Chunks stand in order, hold at most 320 tokens, and together hold every word of the text, each at its place."""
    texts = {r.doc_id: r.text or "" for r in rows_of(spark, sf, "documents")}
    token = re.compile(r"\w+|[^\w\s]")
    by_doc = defaultdict(list)
    for r in run(spark, sf, "d5_d6_chunks"):
        by_doc[r.doc_id].append(r)
    for key, text in texts.items():
        own = sorted(by_doc[key], key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own)))
        covered = set()
        for r in own:
            assert r.tokens == len(token.findall(r.text)) <= 320
            # a cut paragraph keeps places in its cleaned form, which blanks alone set apart from the text's
            if token.findall(text[r.char_start : r.char_end]) == token.findall(r.text):
                covered |= {m.start() + r.char_start for m in token.finditer(text[r.char_start : r.char_end])}
        starts = [m.start() for m in token.finditer(text)]
        if not re.search(r"[ \t\r\f\v]{2}|\n{3}|\0|[\t\r\f\v]", text):
            assert covered >= set(starts)
        assert len(own) >= math.ceil(len(starts) / 320)


def shingle_set(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return {" ".join(words)} if 0 < len(words) < 5 else {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_greedy_decisions(spark, sf):
    from ledgerlake.functions.text import BOILERPLATE

    want = {}
    for r in rows_of(spark, sf, "documents"):
        kept = []
        for k, line in enumerate(x for x in (r.text or "").split("\n") if x.strip(" ")):
            if re.search("|".join(BOILERPLATE), " ".join(re.findall("[a-z0-9]+", line.lower()))):
                want[r.doc_id, k] = "boilerplate"
                continue
            own = shingle_set(line)
            near = any(line == other or alike(own, s) >= 0.9 for other, s in kept)
            want[r.doc_id, k] = "near_copy" if near else "kept"
            kept += [] if near else [(line, own)]
    assert {(r.version, r.chunk_index): r.decision for r in run(spark, sf, "d8_greedy_decisions")} == want


def test_hybrid_retrieval(spark, sf):
    vectors = {r.vec_id: r.embedding for r in rows_of(spark, sf, "embeddings")}
    docs = {r.doc_id: r for r in rows_of(spark, sf, "documents") if r.doc_id in vectors}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    dense = {k: cosine([float(x) for x in vectors[k]], [float(x) for x in vectors[0]]) for k in docs}
    words = {k: re.findall("[a-z0-9]+", (r.text or "").lower()) for k, r in docs.items()}
    lexical = {k: sum(w in ("the", "thst", "that") for w in own) / len(own) for k, own in words.items() if own}
    lexical = {k: s for k, s in lexical.items() if s > 0}
    score = Counter()
    for found in (dense, lexical):
        for rank, k in enumerate(sorted(found, key=lambda k: (-found[k], str(k)))[:50], 1):
            score[k] += 1 / (60 + rank)
    kept, taken, later = [], [], []
    per_document, per_period = Counter(), Counter()
    for k in sorted(score, key=lambda k: (-score[k], str(k))):
        own = shingle_set(docs[k].text)
        if any(docs[k].text == docs[j].text or alike(own, s) >= 0.92 for j, s in kept):
            continue
        kept.append((k, own))
        room = per_document[k % 97] < 3 and (docs[k].lang is None or per_period[docs[k].lang] < 6)
        (taken if room else later).append(k)
        if room:
            per_document[k % 97] += 1
            per_period[docs[k].lang] += docs[k].lang is not None
    want = [*taken, *later][:10]
    got = sorted(run(spark, sf, "r5_hybrid_retrieval"), key=lambda r: r.final_rank)
    assert [int(r.chunk_id) for r in got] == want
    assert [r.score for r in got] == pytest.approx([score[k] for k in want])


def test_leases(spark, sf):
    """Each user's requests in order of time, one by one, on a board of who holds what until when."""
    board, want = {}, Counter()
    for r in sorted(rows_of(spark, sf, "events"), key=lambda r: (r.ts, str(r.event_id % 2))):
        at, who = r.ts.timestamp(), str(r.event_id % 2)
        action = ("release", "acquire", "renew")[r.event_id % 3]
        holder, until = board.get(r.user_id, (None, 0.0))
        mine, live = holder == who, holder is not None and at < until
        yes = {"acquire": not live or mine, "renew": live and mine, "release": mine}[action]
        if yes:
            board[r.user_id] = (None, 0.0) if action == "release" else (who, at + 86400.0)
        want[str(r.user_id), who, action, round(at, 3), yes, board.get(r.user_id, (None,))[0]] += 1
    assert Counter((r.key, r.worker, r.action, round(r.at, 3), r.granted, r.holder) for r in run(spark, sf, "st5_st6_leases")) == want

"""Work that grows with the input: steps whose rows or groups once grew faster, against plain Python."""

import hashlib
import json
import random
import re
import sys

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from ledgerlake.functions import decimals, embed, tables, udfs
from ledgerlake.operators import claims, documents, entities, facts, ingestion, runs, stores


def test_a_shared_name_gives_two_companies_a_mention(spark):
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(["shared", "shared 1", "firm 7", "shared 2 x", "none"])], "mention_id long, name string")
    labels = spark.createDataFrame([(f"T{i}", f"shared {i % 3}") for i in range(60)] + [("F", "firm 7"), ("G", "shared 2 x")], "ticker string, label string")
    got = {(r.mention_id, r.ticker, r.score) for r in entities._named(asked, labels, "name", 100, 80, "company_name").collect()}
    assert got == {(0, "G", 80), (0, "T0", 80), (1, "T1", 100), (1, "T10", 100), (2, "F", 100), (3, "G", 100)}


def test_a_cik_of_many_symbols(spark):
    companies = spark.createDataFrame([(f"A{i:02}", "7", None) for i in range(30)], "ticker string, cik string, name string")
    mentions = spark.createDataFrame([(1, "some", None, "7", None), (2, "some", "a05", "7", None)], "mention_id long, mention string, ticker string, cik string, legal_name string")
    got = sorted((r.mention_id, r.status, r.ticker, r.runner_up if "runner_up" in r else None) for r in entities.rank_companies(mentions, companies).collect())
    assert got == [(1, "ambiguous", None, None), (2, "ambiguous", None, None)]


def test_lines_of_pages_are_read_without_a_group_a_page(spark):
    rng = random.Random(3)
    pages = {p: [(round(rng.uniform(0, 40), 1), float(rng.randint(0, 5)), rng.choice("abc")) for _ in range(rng.randint(0, 60))] for p in range(40)}
    want = []
    for p, words in pages.items():
        number, began, lines = -1, None, {}
        for top, x0, text in sorted(words):
            if began is None or abs(top - began) > 3.0:
                number, began = number + 1, top
            lines.setdefault(number, []).append((top, x0, text))
        want += [(p, n, " ".join(t for *_, t in w), min(x for _, x, _ in w), w[0][0], max(x for _, x, _ in w) + 1, w[-1][0] + 9) for n, w in lines.items()]
    rows = spark.createDataFrame([(p, t, x, s, x + 1, t + 9) for p, words in pages.items() for t, x, s in words], "page_id long, top double, x0 double, text string, x1 double, bottom double")
    got = stores.line_blocks(rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_near_pairs_whatever_the_counts(spark):
    """Equal to brute force for a table of counts of any size; sets of shingles never leave their tasks."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(4, 60))] for _ in range(12)]
    texts = ["", "...", "one two", "one two"] + [" ".join(rng.choice("xyz") if rng.random() < 0.01 else w for w in own) for own in base for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def brute(text):
        words = text.split()
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else set(words)

    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    sets = [(i, s) for t, i in first.items() if (s := brute(t.replace(".", "")))]
    want = sorted((a, b) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= 0.8)
    assert len(want) > 10
    for slots in (1, 64, 1 << 18):
        got = documents.near_pairs(docs, "doc_id", "text", 0.8, slots=slots)
        assert sorted((r.a, r.b) for r in got.collect()) == want


def test_hashed_vectors_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "a b a, Zebra"), (2, None), (3, ""), (4, "x " * 3000), (None, "a")], "k long, text string")
    got = embed.hashed_embedding(rows, "k", "text", 16)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    slot = embed.token_slot(F.col("w"), 16)
    spots = {r.w: (r.s.slot, r.s.sign) for r in spark.createDataFrame([(w,) for w in ("a", "b", "zebra", "x")], "w string").select("w", slot.alias("s")).collect()}
    found = {r.k: r.embedding for r in got.collect()}
    for k, words in ((1, ["a", "b", "a", "zebra"]), (2, []), (3, []), (4, ["x"] * 3000), (None, ["a"])):
        want = [0.0] * 16
        for w in words:
            want[spots[w][0]] += spots[w][1]
        length = sum(x * x for x in want) ** 0.5 or 1.0
        assert found[k] == [x / length for x in want]


def test_shown_quotients_equal_the_expressions(spark):
    prices = ["0.01", "1", "3", "7.77", "0.000001", "99999999.99", "-5.5", "0", None, "123456789012345678901.123456"]
    rows = spark.createDataFrame([(a, b) for a in prices for b in prices], "a string, b string").select(*[F.col(c).cast("decimal(28,6)").alias(c) for c in "ab"])
    a, b = decimals.number(F.col("a")), decimals.number(F.col("b"))
    want = {"g": decimals.plain(decimals.growth(a, b)), "p": decimals.plain(decimals.times_ten(decimals.ratio(a, b), 2)), "r": decimals.plain(decimals.ratio(a, b))}
    got = {"g": decimals.growth_text("a", "b"), "p": decimals.percent_text("a", "b"), "r": decimals.ratio_text("a", "b")}
    for r in rows.filter("a is null or a <> 0").select("a", "b", *[x.alias(f"want_{k}") for k, x in want.items()], *[x.alias(f"got_{k}") for k, x in got.items()]).collect():
        assert [r[f"got_{k}"] for k in got] == [r[f"want_{k}"] for k in got], (r.a, r.b)


def test_greedy_decisions_without_a_group_a_version(spark):
    """Groups that span batches and keys that are null or NaN, against a plain pass; rows move once and aren't joined back."""
    rng = random.Random(7)
    keys = [None, float("nan"), 0.0, 1.5, 2.5]
    said = ["", "...", "a b", "safe harbor", None] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(6)]
    said += [" ".join(f"w{j}{'x' if j == i else ''}" for j in range(60)) for i in (0, 58, 59)]
    rows = [(key, i, rng.choice(said)) for key in keys for i in range(40)]
    want = {}
    for key in keys:
        kept = []
        for _, i, text in (r for r in rows if r[0] is key):
            words = (text or "").split() if text != "..." else []
            mine = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else set(words)
            near = any(mine == s or mine | s and len(mine & s) / len(mine | s) >= 0.9 for s in kept)
            want[str(key), i] = "boilerplate" if text == "safe harbor" else "near_copy" if near else "kept"
            kept += [mine] if want[str(key), i] == "kept" else []
    assert {"kept", "near_copy", "boilerplate"} == set(want.values())
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "v double, i long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = documents.drop_near_copies(frame, "v", "i", "text")
        assert {(str(r.v), r.i): r.decision for r in got.collect()} == want and got.columns == ["v", "i", "text", "decision"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan


def test_payloads_are_told_apart_by_kind_without_their_schema(spark):
    kinds = {'{"a":{}}': True, '{"a":[]}': True, '{"a":{"b":[1,null]}}': True, '{"a":[1,{"c":2}]}': True, '{"a":1}': False, '{"a":"{}"}': False, '{"a":null}': False, '{"b":{}}': False, "[1]": False, "{": False, "": False, None: False}
    got = spark.createDataFrame([(x,) for x in kinds], "payload string").select("payload", runs.object_at("payload", "$.a").alias("ok"))
    assert {r.payload: r.ok for r in got.collect()} == kinds
    assert "schema_of_variant" not in got._jdf.queryExecution().toString().lower()


def test_source_hashes_need_no_patterns(spark):
    said = ['a"b\\c\\"d', None, "", '\\\\""', "é$1"]
    got = spark.createDataFrame([(x, i) for i, x in enumerate(said)], "x string, i int").select("x", "i", facts.source_hash({"x": F.col("x"), "i": F.col("i")}).alias("h"))
    for r in got.collect():
        want = json.dumps({"i": str(r.i), "x": r.x}, sort_keys=True, ensure_ascii=False)
        assert r.h == hashlib.sha256(want.encode()).hexdigest()
    assert "regexp_replace" not in got._jdf.queryExecution().toString()


def test_outputs_are_cleared_without_sorting_them(spark):
    versions = spark.createDataFrame([(1,), (1,), (3,), (None,)], "version_id long")
    rows = spark.createDataFrame([(k, i) for k in (1, 2, 3, 4, None) for i in range(3)], "version_id long, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ingestion.cleared({"chunks": rows, "summaries": rows.limit(0)}, versions)
        assert sorted((str(r.version_id), r.id) for r in got["chunks"].collect()) == [(k, i) for k in ("2", "4", "None") for i in range(3)]
        assert got["summaries"].count() == 0
        assert "SortMergeJoin" not in got["chunks"]._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_html_is_parsed_once_and_a_few_rows_at_a_time(spark):
    pages = [None, "", "<p>a<script>b</script> c</p>", "<svg>x</svg>&amp;<b> y </b>"] * 40
    got = spark.createDataFrame(list(enumerate(pages)), "k long, html string").coalesce(1).select("k", udfs.html_texts("html").alias("t"), udfs.html_text("html").alias("one"))
    for r in got.collect():
        assert (r.t.text, r.t.all_text, r.one) == (udfs.text_of_html(pages[r.k]), udfs.text_of_html(pages[r.k], False), udfs.text_of_html(pages[r.k]))
    made = udfs.by_rows(lambda a, b: a + b, pa.int64(), pa.array(range(200)), pa.array(range(200)))
    assert made.to_pylist() == list(range(0, 400, 2)) and udfs.by_rows(str, pa.string(), pa.array([], pa.int64())).to_pylist() == []


def test_chunks_leave_a_task_a_few_documents_at_a_time(spark):
    texts = [None, "", "one\n\ntwo"] + [" ".join(f"w{i}" for i in range(1000))] * 197
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    got = documents.chunks(docs, "k", "text")
    want = [(k, i, *chunk) for k, t in enumerate(texts) for i, chunk in enumerate(documents.packed_chunks(t or "", 320, 40))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and got.schema["k"].dataType.simpleString() == "int"
    assert "MapInPandas" not in got._jdf.queryExecution().toString()


def test_lower_case_keeps_places_for_every_character():
    """Patterns without case, and patterns in lower case on the lowered text, agree on every character."""
    ascii_of = [re.compile(c, re.IGNORECASE) for c in "abcdefghijklmnopqrstuvwxyz"]
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    low = udfs.lower_alike(every)
    assert len(low) == len(every)
    for pattern in ascii_of:
        assert [m.start() for m in pattern.finditer(every)] == [m.start() for m in re.finditer(pattern.pattern, low)]
    for kind in (r"\w", r"\s", r"[^\n]"):
        assert [m.start() for m in re.finditer(kind, every)] == [m.start() for m in re.finditer(kind, low)]


def test_sections_are_those_of_patterns_without_case():
    rng = random.Random(11)
    parts = ["Item 1. Business", "ITEM 1A - RISK FACTORS", "ıtem 7. Management's Discussion and Analysis", "İtem 7a: quantitative and qualitative diſcloſures", "Rısk factors", "Liquidity and capital\n resources", "competition", "Competitions", "STRATEGY", "outlooK", "outlooK", "item 8", "items 1", "ẞ Straße", "x" * 600, " \t ", "\n", "item 3. quantitative and qualitative disclosures", "subitem 2"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(0, 25)))
        chosen = {}
        items = [m.start() for m in re.finditer(udfs.NEXT_ITEM, text, re.IGNORECASE)] + [len(text)]
        for key, (_, pattern) in udfs.SECTIONS.items():
            spans = [m.span() for m in re.finditer(pattern, text, re.IGNORECASE)]
            full = [a for a, b in spans if min(i for i in items if i >= b) - a >= udfs.LEAST_BODY]
            if spans:
                chosen[(full or [spans[-1][0]])[0]] = key
        marks = sorted({*items, *chosen})
        want = [(chosen[a], a, next((m for m in marks if m > a), a)) for a in sorted(chosen)]
        assert [(s["section_key"], s["start"], s["stop"]) for s in udfs.sections_of(text)] == want
    assert udfs.single_blanks(" a \t\t b\r\n\n c\v\f") == re.sub(r"[ \t\r\f\v]+", " ", " a \t\t b\r\n\n c\v\f")


def test_table_functions_hand_out_rows_not_tables(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else f"Item 1. Business {'word ' * 200} competition") for i in range(150)], "k long, text string").coalesce(1)
    for name, call in (("chunks", "chunks(r.text, 40, 5)"), ("sections", "sections(r.text)"), ("claims", "claims(r.text)")):
        got = spark.sql(f"SELECT r.k, c.* FROM {{r}} r, LATERAL {call} c", r=rows)
        assert "ArrowEvalPythonUDTF" not in got._jdf.queryExecution().toString(), name
        assert {r.k for r in got.collect()} == {i for i in range(150) if i % 50}


def test_claims_are_cut_a_few_answers_at_a_time(spark):
    said = [None, "", "## Answer\n\nIt rose 5 percent [fact:1]. It fell. [fact:2] Note: none.", "| a | b |\n|---|---|\n| x | 3 |"] * 50
    got = claims.claims(spark.createDataFrame(list(enumerate(said)), "answer_id long, answer string").coalesce(1))
    want = [(k, c["claim_id"], c["text"], c["evidence_ids"], c["material"], c["sentence_index"]) for k, t in enumerate(said) for c in claims.claims_of(t)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 100
    assert claims.extract_claims.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF

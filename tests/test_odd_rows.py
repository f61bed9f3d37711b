"""Bounds and orders that queries over the driver's tables don't show: long names, many Arrow batches, late rows, odd mentions."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlake.operators import claims, entities, stores
from ledgerlake.streaming import events, late


def test_names_of_any_length_are_found(spark):
    long = " ".join(f"word{k}" for k in range(200))
    firms = spark.createDataFrame([("L", long), ("S", "Acme Tools"), ("N", "word0 word1 word2 word3 word4 word5 word6 word7 other")], "ticker string, name string")
    texts = spark.createDataFrame([(1, f"Ask {long} now"), (2, long.rsplit(" ", 1)[0]), (3, "ACME tools, L."), (4, None)], "id long, text string")
    got = {(r.id, r.ticker, r.match_kind) for r in entities.tickers_named(texts, firms, "id", "text").collect()}
    assert got == {(1, "L", "company_name"), (3, "S", "company_name")}
    asked = texts.select(F.lit(1).alias("answer_id"), F.col("id").alias("claim_id"), "text")
    evidence = firms.select(F.lit(1).alias("answer_id"), F.col("name").alias("company_name"))
    assert {(r.claim_id, len(r.name.split())) for r in claims._mentioned(asked, evidence, "company_name").collect()} == {(1, 200), (3, 2)}
    assert claims._mentioned(asked, evidence.filter("false"), "company_name").count() == 0


def test_rate_limit_by_time_over_several_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, "u", start + timedelta(seconds=(k * 37) % 200)) for k in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        log = spark.readStream.schema("event_id long, user_id string, ts timestamp").parquet(str(tmp_path / "events.parquet"))
        got = events.drained(events.rate_limit_stream(log, "user_id", "ts", 3600, 25)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    first = sorted(r.at for r in got)[:25]
    assert len(got) == 200 and sorted(r.at for r in got if r.accepted) == first


def test_late_rows_are_kept_apart(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[(1, 0), (2, 50), (3, None)], [(4, 39), (5, 41), (6, 200)], [(7, 189), (8, 190)]]
    schema = "id long, ts timestamp"
    for n, batch in enumerate(batches):
        spark.createDataFrame([(k, None if s is None else start + timedelta(seconds=s)) for k, s in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        kept, behind = late.kept_and_late(stream, str(tmp_path / "out"), "ts", 10.0)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 5, 6, 8] and sorted(r.id for r in behind.collect()) == [3, 4, 7]


def test_lines_find_their_places(spark):
    rows = [(1, 0, "a b", "a b\na b\n x a b"), (1, 1, " ", None), (1, 2, "a b", None), (1, 3, "gone", None), (1, 4, "x", None), (2, 0, "é ü", "ö é ü"), (3, 0, "no page", None)]
    lines = spark.createDataFrame([(p, n, t) for p, n, t, _ in rows], "page_id long, line long, text string")
    pages = spark.createDataFrame([(1, rows[0][3]), (2, "ö é ü"), (4, "")], "page_id long, page_text string")
    got = sorted(((r.page_id, r.line, r.char_start, r.char_end) for r in stores.spanned_lines(lines, pages).collect()))
    assert got == [(1, 0, 0, 3), (1, 2, 4, 7), (1, 3, None, None), (1, 4, 9, 10), (2, 0, 2, 5), (3, 0, None, None)]


def brute_mention(question, mention, ticker, legal):
    fold = lambda x: " ".join(re.sub(r"[^\w]+", " ", (x or "").casefold()).split())
    said = lambda x: bool(fold(x)) and f" {fold(x)} " in f" {fold(question)} "
    if said(mention):
        return mention
    symbol = (ticker or "").strip().upper().removeprefix("$")
    if symbol and re.search(rf"(?<![A-Za-z0-9])\${'?' if len(symbol) > 1 else ''}{re.escape(symbol)}(?![A-Za-z0-9])", question or "", re.I):
        return ticker
    for name in (legal, mention):
        words = re.findall(r"\w+", name or "")[:4]
        for n in range(len(words), 0, -1):
            run = " ".join(words[:n])
            if fold(run) not in entities.PREFIX_STOPWORDS and said(run):
                return run
    return None


def test_explicit_mentions_equal_the_rules(spark):
    questions = ["How did ACME Tools do?", "is $F up", "is F up", "brk.b or BRK.B?", "The Straße AG report", "ocean-blue trading", None, "", "The company", "a\\Eb (x)"]
    names = [("Acme Tools", "ACM", None), ("Ford", "F", "Ford Motor"), ("Berkshire", "BRK.B", "Berkshire Hathaway Inc"), ("STRASSE", None, "Straße AG"), ("Blue", "OB", "Ocean Blue Trading Group Ltd"), ("The Company", "a\\Eb", "The Company Inc"), (None, None, None), ("", " ", "a b c d e")]
    rows = [(100 * i + j, q, m, t, None, n) for i, q in enumerate(questions) for j, (m, t, n) in enumerate(names)]
    df = spark.createDataFrame(rows, "question_id long, question string, mention string, ticker string, cik string, legal_name string").withColumn("_m", F.lit("clash"))
    got = {r.question_id: r.mention for r in entities.explicit_mentions(df.unionAll(df)).collect()}
    want = {k: m for k, q, a, t, _, n in rows if (m := brute_mention(q, a, t, n)) is not None}
    assert sorted(got.items()) == sorted(want.items()) and len(got) == 7


def test_table_functions_equal_the_frames(spark, sf):
    from ledgerlake import catalogue, queries as _  # noqa: F401
    from ledgerlake.functions.tables import register

    plain = lambda name: sorted(map(str, catalogue.QUERIES[name](spark, sf).collect()))
    assert plain("d5_chunks_by_sql") == plain("d5_d6_chunks")
    from ledgerlake.functions.udfs import detect_sections
    from ledgerlake.queries.tables import reports

    frame = reports(spark, sf).select("doc_id", F.inline(detect_sections("text")))
    assert plain("s15_sections_by_sql") == sorted(map(str, frame.collect())) and frame.count() > 200
    register(spark)
    text = "Item 1A. Risk Factors " + "risk " * 200 + " Item 7. Management's Discussion and Analysis " + "growth " * 200 + " Item 8. Statements"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    assert {r.id for r in spark.sql("SELECT t.id, s.* FROM {t} t, LATERAL sections(t.text) s", t=rows).collect()} == {1}
    assert spark.sql("SELECT c.* FROM {t} t, LATERAL claims(t.text) c WHERE t.id > 1", t=rows).count() == spark.sql("SELECT c.* FROM {t} t, LATERAL chunks(t.text, 9, 2) c WHERE t.id > 1", t=rows).count() == 0


def test_chunks_overlap_and_are_packed():
    """Fixed windows begin `overlap` tokens before the last one's end; paragraphs are packed until the next doesn't fit."""
    import random

    from ledgerlake.operators.documents import count_tokens, fixed_chunks, paragraph_chunks, word_spans

    rng = random.Random(12)
    for _ in range(200):
        most = rng.randrange(2, 30)
        overlap = rng.randrange(0, most)
        text = " ".join(f"w{k}" + rng.choice(["", ".", ",", " -"]) for k in range(rng.randrange(1, 120)))
        spans = word_spans(text)
        begins, ends = {a: i for i, (a, _) in enumerate(spans)}, {b: i + 1 for i, (_, b) in enumerate(spans)}
        got = [(begins[a], ends[b]) for a, b in fixed_chunks(text, most, overlap)]
        assert got[0][0] == 0 and got[-1][1] == len(spans) and all(0 < b - a <= most for a, b in got)
        assert all(b - a == most for a, b in got[:-1]) and all(x[0] == y[1] - overlap for y, x in zip(got, got[1:]) if overlap < most)

        words = [rng.randrange(1, most + 1) for _ in range(rng.randrange(1, 15))]
        paragraphs = [" ".join(f"p{i}x{j}" for j in range(n)) for i, n in enumerate(words)]
        packed = paragraph_chunks("\n\n".join(paragraphs), most, 0)
        # without an overlap: the greedy filling of windows by whole paragraphs
        want, held = [], []
        for own, n in zip(paragraphs, words):
            if held and sum(len(p.split()) for p in held) + n > most:
                want, held = [*want, "\n\n".join(held)], []
            held.append(own)
        assert [t for _, _, t in packed] == [*want, "\n\n".join(held)]
        lapped = [t for _, _, t in paragraph_chunks("\n\n".join(paragraphs), most, overlap)]
        seen = " ".join(lapped).split()
        assert set(seen) == set(" ".join(paragraphs).split()) and all(count_tokens(t) <= most for t in lapped)

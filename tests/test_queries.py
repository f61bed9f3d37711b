import math
import os
from datetime import date

import duckdb
import pytest

from ledgerlake import catalogue, queries as _  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf, name)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, oracle, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.ORACLES:  # tests/test_oracles.py compares these
        assert rows
        return
    found = oracle.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(plain(v) for v in row)) for row in found.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in names)) for r in rows) == want


def test_equal_texts_have_a_row_each(spark, sf):
    """Copies without any other near text are found, though they make no pair."""
    from ledgerlake.operators.documents import near_pairs, text_classes

    same, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(4, same), (2, same), (9, same), (3, other), (7, None), (8, None)], "doc_id long, text string")
    assert near_pairs(docs.filter("text is not null"), "doc_id", "text", 0.8).count() == 0
    got = {r.doc_id: (r.class_id, r.n_equal) for r in text_classes(docs, "doc_id", "text").collect()}
    assert got == {4: (2, 3), 2: (2, 3), 9: (2, 3), 3: (3, 1), 7: (7, 1), 8: (8, 1)}
    assert catalogue.QUERIES["d8_text_classes"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_growth_of_a_shifted_calendar(spark):
    from ledgerlake.operators.series import year_over_year_dated

    df = spark.createDataFrame([("x", date(2024, 3, 23), 18.25e9), ("x", date(2025, 3, 22), 17.919e9), ("x", date(2026, 3, 21), 19.443e9), ("x", date(2024, 2, 29), 1.0)], "k string, observed_at date, value double")
    got = {r.observed_at: round(r.growth, 2) for r in year_over_year_dated(df, ["k"]).collect()}
    assert got == {date(2025, 3, 22): -1.81, date(2026, 3, 21): 8.5}


def test_chunks_keep_their_places():
    from ledgerlake.operators.documents import fixed_chunks, paragraph_chunks, word_spans

    text = "One two three. Four five!\n\nSix seven eight nine ten eleven twelve.\n\nLast."
    for a, b in fixed_chunks(text, 5, 2):
        assert len(word_spans(text[a:b])) <= 5
    assert all(len(word_spans(t)) <= 6 for _, _, t in paragraph_chunks(text, 6, 2))
    assert fixed_chunks("", 5, 1) == []


def test_company_facts(spark):
    import json

    from ledgerlake.sources.payloads import company_facts, unmapped_concepts

    row = {"start": "2024-01-01", "end": "2024-12-31", "val": 10, "accn": "0001-24-1", "fy": 2024, "fp": "FY", "form": "10-K/A", "filed": "2025-02-01"}
    facts = {"us-gaap": {"Revenues": {"label": "R", "units": {"USD": [row, {"start": "x", "end": "2024-03-31", "val": 2}, {"end": "2024-03-31"}]}}, "Other": {"label": "O", "units": {"USD": [{"end": "2024-01-01", "val": 1}]}}}}
    df = spark.createDataFrame([(json.dumps({"cik": 7, "entityName": "E", "facts": facts}),)], "payload string")
    mapping = {"metrics": {"revenue": {"us-gaap": ["Revenues"]}}}
    got = {(r.concept, str(r.period_end)): (r.metric, r.period_type, r.is_amendment) for r in company_facts(df, mapping).collect()}
    assert got == {("Revenues", "2024-12-31"): ("revenue", "annual", True), ("Revenues", "2024-03-31"): ("revenue", "instant", False), ("Other", "2024-01-01"): (None, "instant", False)}
    assert [r.concept for r in unmapped_concepts(df, mapping).collect()] == ["Other"]


def test_context_keeps_its_budget():
    from ledgerlake.operators.retrieval import assemble
    from ledgerlake.plans.requests import Budget

    pieces = [{"kind": "chunk", "label": f"c{k}", "company_id": k % 2, "fiscal_year": 2024, "fiscal_period": "FY", "document_id": k, "content": "word " * 40, "tokens": 50} for k in range(9)]
    taken = assemble(pieces, Budget(documents=3, tokens=120))
    assert [e["label"] for e in taken] == ["c0", "c1", "c2"] and taken[-1]["tokens"] == 20


def test_strategies_read_their_sources(spark):
    from ledgerlake.operators.retrieval import strategy_evidence

    frame = lambda kind: spark.createDataFrame([(kind,)], "kind string")
    sources = {k: lambda k=k: frame(k) for k in ("documents", "sections", "facts")}
    asked = []
    search = lambda mode, n: asked.append((mode, n)) or spark.createDataFrame([("chunk", 1)], "kind string, rank int")
    for strategy, attempt, kinds, action in (("summary_only", 1, ["documents"], "document_summary_lookup"), ("hybrid", 1, ["documents", "sections", "facts", "chunk"], "combine_structured_and_text_evidence"), ("detailed", 2, ["documents", "sections", "chunk"], "lexical_fallback")):
        rows, said = strategy_evidence(strategy, attempt, 14, sources, search)
        assert [r.kind for r in rows.collect()] == kinds and said == action
    assert asked == [("hybrid", 12), ("lexical", 14)] and strategy_evidence("none", 1, 5, sources, search) == (None, "abstain_before_search")


def test_modes_are_compared(spark):
    from ledgerlake.operators.retrieval import compared_modes

    rows = [(1, 1, "alpha beta one", [1.0, 0.0], "p", "a"), (2, 2, "gamma delta two", [0.0, 1.0], "p", "b"), (3, 3, "alpha epsilon three", [0.9, 0.1], "p", "c")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string, embedding array<double>, period string, key string")
    expected = spark.createDataFrame([("q", "a"), ("q", "c")], "query string, key string")
    got = {r["mode"]: (r.recall, round(r.precision, 3), r.duplicate_rate) for r in compared_modes(chunks, [("q", "alpha", [1.0, 0.0])], expected, top_k=2).collect()}
    assert got == {"dense": (1.0, 1.0, 0.0), "lexical": (1.0, 1.0, 0.0), "hybrid": (1.0, 1.0, 0.0)}


def test_accepted_events_stream(spark, tmp_path):
    from ledgerlake.streaming.events import append_once, event_stream

    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log.write.parquet(f"{tmp_path}/log/events.parquet")
    log.write.parquet(f"{tmp_path}/log/again/events.parquet")
    stream = append_once(event_stream(spark, f"{tmp_path}/log/*", log.schema, "*.parquet"), ["event_id"], delay="60 days")
    run = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("once").count() == spark.table("once").select("event_id").distinct().count()

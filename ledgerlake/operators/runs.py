"""Ingestion runs over payloads of macro series, filings and facts, each published whole in a store.

A run takes one row an item, whose payloads someone has fetched. An item that can't be read fails alone, with its stage and
a message, and none of its rows are loaded; the others go on. Rows that are stored as they are now aren't written again, so a
rerun over the same payloads adds nothing but its own counters. Of several rows of a key within a run the one that sorts last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.operators.facts import insert_new
from ledgerlake.operators.macro import VINTAGE, observation_hash, upsert
from ledgerlake.session import stored
from ledgerlake.sources import payloads as P
from ledgerlake.sources.store import Store

TABLES = {
    "series": "series_id string, title string, observation_start date, observation_end date, frequency string, unit string, seasonal_adjustment string, last_updated string",
    "observations": "series_id string, observed_at date, realtime_start date, realtime_end date, value decimal(38,12), unit string, source_hash string",
    "filings": "accession_number string, cik string, form string, filing_date date, report_date date, document string",
    "versions": "accession_number string, content_hash string, size_bytes long",
    "facts": "cik string, taxonomy string, concept string, metric string, unit string, period_start date, period_end date, value decimal(28,6), accession_number string, form string, period_type string, is_amendment boolean, source_hash string",
    "failures": "run string, item string, stage string, message string",
    "runs": "run string, source string, status string, items_seen long, rows_seen long, inserted long, updated long, duplicates long, missing long, failures long",
}


def object_at(payload: str, path: str) -> Column:
    """Whether a payload is JSON with an object or array at a path; what they hold isn't looked at."""
    parsed = F.try_parse_json(F.col(payload))
    return F.try_variant_get(parsed, path, "map<string,variant>").isNotNull() | F.try_variant_get(parsed, path, "array<variant>").isNotNull()


def _counters(run: str, source: str, items: DataFrame, failures: DataFrame, seen: DataFrame) -> DataFrame:
    """The run's row: `items` have one row an item that went well, `seen` one an incoming row with its action and whether its value is missing."""
    n = lambda said: F.count_if(F.col("action") == said)
    each = seen.agg(F.count(F.lit(1)).alias("rows_seen"), n("inserted").alias("inserted"), n("updated").alias("updated"), n("noop").alias("duplicates"), F.count_if("missing").alias("missing"))
    one = items.agg(F.count(F.lit(1)).alias("items_seen")).crossJoin(failures.agg(F.count(F.lit(1)).alias("failures"))).crossJoin(each)  # one row each
    return one.select(F.lit(run).alias("run"), F.lit(source).alias("source"), F.when(F.col("failures") == 0, "success").otherwise("partial_failed").alias("status"), "items_seen", "rows_seen", "inserted", "updated", "duplicates", "missing", "failures")


def _failed(run: str, rows: DataFrame, item: str, stage: str, message: Column) -> DataFrame:
    return rows.select(F.lit(run).alias("run"), F.col(item).cast("string").alias("item"), F.lit(stage).alias("stage"), message.alias("message"))


def macro_run(store: Store, run: str, items: DataFrame) -> None:
    """items: series_id, metadata, observations (payloads). Series are whole rows, observations a row a vintage with a hash of what it says."""
    if store.published(run):
        return
    fault = F.when(F.col("series_id").isNull(), "no series").when(~object_at("metadata", "$.seriess[0]"), "no metadata").when(~object_at("observations", "$.observations"), "no observations")
    rows = stored(items.withColumn("_fault", fault))
    good = rows.filter("_fault is null")
    failures = _failed(run, rows.filter("_fault is not null"), "series_id", "series", F.col("_fault"))
    told = P.macro_metadata(good.withColumnRenamed("metadata", "payload"))
    series = told.groupBy("series_id").agg(F.max(F.struct(*[c for c in told.columns if c != "series_id"])).alias("_s")).select("series_id", "_s.*")
    units = series.select(F.col("series_id").alias("_series"), "unit")
    found = P.observations_of(good, F.upper("series_id")).join(units, F.col("series_id") == F.col("_series"), "left").drop("_series").filter("observed_at is not null")
    hashed = found.withColumn("source_hash", observation_hash())
    rest = [c for c in hashed.columns if c not in VINTAGE]
    batch = stored(hashed.groupBy(*VINTAGE).agg(F.max(F.struct(*rest)).alias("_o")).select(*VINTAGE, "_o.*"))
    held = store.latest("observations", list(VINTAGE)).select(batch.columns)
    laid = stored(upsert(held, batch).filter("action <> 'kept'"))
    known = store.latest("series", ["series_id"]).select(series.columns)
    fresh = laid.filter("action in ('inserted', 'updated')")
    seen = laid.select("action", F.col("value").isNull().alias("missing"))
    store.publish(run, {"series": series.exceptAll(known), "observations": fresh, "failures": failures, "runs": _counters(run, "macro", good.select("series_id"), failures, seen)})


def filings_run(store: Store, run: str, items: DataFrame, documents: DataFrame, forms: tuple[str, ...], per_form: int) -> None:
    """items: ticker, submissions (payload); documents: accession_number, content (bytes; null if it couldn't be fetched).

    A company whose submissions can't be read fails as a company, a filing without a document as a filing. A filing's new
    content is a version; one that a company's earlier load has brought is a duplicate.
    """
    if store.published(run):
        return
    rows = stored(items.withColumn("_ok", object_at("submissions", "$.filings.recent")))
    good = rows.filter("_ok")
    recent = P.recent_filings(good.withColumnRenamed("submissions", "payload"), forms, per_form).drop("pos").dropDuplicates(["accession_number"])
    bytes_of = documents.groupBy("accession_number").agg(F.max("content").alias("content"))
    both = stored(recent.join(bytes_of.withColumnRenamed("accession_number", "_a"), F.col("accession_number") == F.col("_a"), "left").select(*recent.columns, F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes")))
    whole = both.filter("content_hash is not null")
    failures = _failed(run, rows.filter("not _ok"), "ticker", "company", F.lit("no submissions")).unionByName(_failed(run, both.filter("content_hash is null"), "accession_number", "filing", F.lit("no document")))
    held = store.latest("versions", ["accession_number"]).select("accession_number", F.col("content_hash").alias("_held"))
    laid = stored(whole.join(held, "accession_number", "left").withColumn("action", F.when(F.col("_held").isNull(), "inserted").when(F.col("_held") == F.col("content_hash"), "noop").otherwise("updated")))
    known = store.latest("filings", ["accession_number"])
    filings = whole.select(known.columns).exceptAll(known)
    store.publish(run, {"filings": filings, "versions": laid.filter("action <> 'noop'"), "failures": stored(failures), "runs": _counters(run, "filings", good.select("ticker"), failures, laid.select("action", F.lit(False).alias("missing")))})


def facts_run(store: Store, run: str, items: DataFrame, mapping: dict) -> None:
    """items: ticker, payload (company facts). Facts of mapped concepts are kept once each, by the hash of what they say."""
    if store.published(run):
        return
    rows = stored(items.withColumn("_ok", object_at("payload", "$.facts")))
    failures = _failed(run, rows.filter("not _ok"), "ticker", "company_facts", F.when(F.col("payload").isNull(), "no payload").otherwise("payload has no facts"))
    held = store.table("facts")
    found = stored(P.company_facts(rows.filter("_ok").select("payload"), mapping).filter("metric is not null").select(*held.drop("_run").columns))
    fresh = stored(insert_new(held.select("source_hash"), found)[0])  # counted and published
    counts = found.agg(F.count(F.lit(1)).alias("rows_seen")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("inserted")))
    one = counts.crossJoin(rows.agg(F.count_if("_ok").alias("items_seen"), F.count_if(~F.col("_ok")).alias("failures")))  # one row each
    zero = F.lit(0).cast("long")
    counters = one.select(
        F.lit(run).alias("run"), F.lit("facts").alias("source"), F.when(F.col("failures") == 0, "success").otherwise("partial_failed").alias("status"), "items_seen", "rows_seen",
        "inserted", zero.alias("updated"), (F.col("rows_seen") - F.col("inserted")).alias("duplicates"), zero.alias("missing"), "failures",
    )
    store.publish(run, {"facts": fresh, "failures": failures, "runs": counters})

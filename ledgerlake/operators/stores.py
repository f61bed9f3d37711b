"""Stores of documents, versions, pages, failures and runs: each load is a batch of rows merged into what is stored.

Parquet has no row updates, so every function returns what a table holds after the load, or the rows to append.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlake.functions.udfs import line_spans

# Forms that cover a fiscal year.
ANNUAL_FORMS = ("10-K", "20-F", "40-F")
PAGES_AT_ONCE = 256


def fiscal_fields(form: Column, report_date: Column) -> dict[str, Column]:
    """A filing's fiscal year, and FY as its period if its form, amendments included, is annual."""
    return {"fiscal_year": F.year(report_date), "fiscal_period": F.when(F.regexp_replace(form, "/A$", "").isin(*ANNUAL_FORMS), "FY")}


def pdf_source_id(manifest_id: Column, url: Column) -> Column:
    """manifest: and the id, else url: and the first 24 digits of the address's sha256."""
    named = F.when(manifest_id != "", F.concat(F.lit("manifest:"), manifest_id))
    return F.coalesce(named, F.concat(F.lit("url:"), F.left(F.sha2(url.cast("binary"), 256), F.lit(24))))


def merged(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All keys' rows after a load: of several rows of a key the last by `order` in the batch, which beats the stored one."""
    both = stored.withColumn("_late", F.lit(0)).unionByName(batch.withColumn("_late", F.lit(1)))
    rest = [c for c in batch.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_late", order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*batch.columns)


def companies_of(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch with the stored company_id: by cik, else by display name where the cik is missing or unknown."""
    by_cik = stored.filter("cik is not null").groupBy(F.col("cik").alias("_cik")).agg(F.min("company_id").alias("_by_cik"))
    by_name = stored.filter("display_name is not null").groupBy(F.col("display_name").alias("_name")).agg(F.min("company_id").alias("_by_name"))
    found = batch.join(by_cik, F.col("cik") == F.col("_cik"), "left").join(by_name, F.col("display_name") == F.col("_name"), "left")
    return found.withColumn("company_id", F.coalesce("_by_cik", "_by_name")).drop("_cik", "_by_cik", "_name", "_by_name")


def versions(loads: DataFrame, document: str = "document_id", digest: str = "content_hash", run: str = "run") -> DataFrame:
    """(document, digest, first_run, last_run, is_current, supersedes) of all loads of all documents.

    Each distinct content is a version, from its first load. The content of a document's last load is current, an
    old content that comes back included; no other version stays current beside it. A version supersedes the one
    that first came before it.
    """
    each = loads.groupBy(document, digest).agg(F.min(run).alias("first_run"), F.max(run).alias("last_run"))
    own = W.partitionBy(document)
    return each.withColumns({"is_current": F.col("last_run") == F.max("last_run").over(own), "supersedes": F.lag(digest).over(own.orderBy("first_run", digest))})


def replaced(stored: DataFrame, batch: DataFrame, version: str = "version_id") -> DataFrame:
    """Pages or blocks after a new parse: a parsed version's rows are exactly the batch's, those it lacks are gone."""
    return stored.join(batch.select(version).distinct(), version, "left_anti").unionByName(batch)


def open_failures(log: DataFrame) -> DataFrame:
    """(item, stage, error, n_failures): items whose last event is a failure; `log` has item, stage, at, error, null if solved."""
    last = log.groupBy("item", "stage").agg(F.max_by("error", "at").alias("error"), F.count("error").alias("n_failures"))
    return last.filter("error is not null")


def run_status(items: DataFrame) -> DataFrame:
    """(run_id, n_items, n_failed, status): completed, partial if any item failed, failed if all did."""
    counts = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_items"), F.count("error").alias("n_failed"))
    return counts.withColumn("status", F.when(F.col("n_failed") == 0, "completed").when(F.col("n_failed") == F.col("n_items"), "failed").otherwise("partial"))


def failed_tickers(failures: DataFrame, tickers: DataFrame) -> DataFrame:
    """Distinct tickers of open failures: the one in the failure's details, else the company's first current primary symbol."""
    primary = tickers.filter("is_primary and valid_to is null").groupBy("company_id").agg(F.min("symbol").alias("_symbol"))
    named = failures.join(primary, "company_id", "left")
    told = F.coalesce(F.get_json_object("details", "$.ticker"), F.col("_symbol"))
    return named.select(F.upper(told).alias("ticker")).filter("ticker is not null").distinct()


def scanned_documents(pages: DataFrame) -> DataFrame:
    """(document_id, n_pages, n_empty, scanned): a document without text on any page can't be used and isn't tried again."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(empty).alias("n_empty"))
    return counts.withColumn("scanned", F.col("n_pages") == F.col("n_empty"))


def accepted_runs(runs: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch with `accepted`: a session that has a queued or running run, or an earlier one in the batch, must wait."""
    busy = runs.filter(F.col("status").isin("queued", "running")).select(F.col("session_id").alias("_session")).distinct().withColumn("_busy", F.lit(True))
    first = batch.groupBy("session_id").agg(F.min_by("run_id", F.struct("created_at", "run_id")).alias("_first"))
    rows = batch.join(busy, F.col("session_id") == F.col("_session"), "left").join(first.withColumnRenamed("session_id", "_own"), F.col("session_id") == F.col("_own"), "left")
    return rows.withColumn("accepted", F.col("_busy").isNull() & (F.col("run_id") == F.col("_first"))).select(*batch.columns, "accepted")


def source_checks(facts: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newest fact of each company by filing day or else period end, newest filing of each company and form)."""
    day = F.coalesce(F.col("filed_date"), F.col("period_end")).cast("string")
    newest = facts.groupBy("company_id").agg(F.max_by("fact_id", F.struct(day.alias("d"), "fact_id")).alias("fact_id"), F.max(day).alias("day"))
    return newest, filings.groupBy("company_id", "form").agg(F.max_by("accession_number", F.struct("filing_date", "accession_number")).alias("accession_number"))


def check_counts(newest: DataFrame, current_from: str, stale_from: str) -> DataFrame:
    """(status, n): how many companies' newest facts are current, stale or outdated by their day."""
    status = F.when(F.col("day") >= current_from, "current").when(F.col("day") >= stale_from, "stale").otherwise("outdated")
    return newest.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


LINE = "line long, text string, x0 double, top double, x1 double, bottom double"


def page_lines(pages: DataFrame, gap: float = 3.0) -> DataFrame:
    """(page_id, line, text, x0, top, x1, bottom) of pages that hold their `words`: array of (top, x0, text, x1, bottom).

    Words are taken by top and left edge; one that lies over `gap` below the first word of a line begins the next. A
    line depends on where the one before began, so a page, which its paper bounds, is read in one piece.
    """

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column(1)
        top, x0, x1, bottom = (words.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("top", "x0", "x1", "bottom"))
        stops = np.cumsum(np.asarray(words.value_lengths())).tolist()
        starts, page, number, at = [], [], [], 0
        for row, stop in enumerate(stops):
            own, first, line = top[at:stop], 0, 0
            while first < len(own):
                starts.append(at + first)
                page.append(row)
                number.append(line)
                after = max(first + 1, int(np.searchsorted(own, own[first] + gap, "right")))
                while after > first + 1 and own[after - 1] - own[first] > gap:  # sums round otherwise than differences
                    after -= 1
                while after < len(own) and not own[after] - own[first] > gap:
                    after += 1
                first, line = after, line + 1
            at = stop
        texts = pa.ListArray.from_arrays(pa.array([*starts, at], pa.int32()), words.flatten().field("text"))
        of = lambda f, values: pa.array(f.reduceat(values, starts) if starts else np.zeros(0))
        made = [batch.column(0).take(pa.array(page, pa.int64())), pa.array(number, pa.int64()), pc.binary_join(texts, " "), of(np.fmin, x0), of(np.fmin, top), of(np.fmax, x1), of(np.fmax, bottom)]
        return pa.RecordBatch.from_arrays(made, names=["page_id", "line", "text", "x0", "top", "x1", "bottom"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                yield lines(batch.slice(i, PAGES_AT_ONCE))

    number = lambda c: lambda w: F.coalesce(w[c].cast("double"), F.lit(float("nan"))).alias(c)
    held = F.transform("words", lambda w: F.struct(number("top")(w), number("x0")(w), w["text"].alias("text"), number("x1")(w), number("bottom")(w)))
    return pages.select("page_id", F.array_sort(held).alias("words")).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, {LINE}")


def line_blocks(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """(page_id, line, text, x0, top, x1, bottom) of words in rows, as `page_lines` makes them of each page's."""
    own = F.collect_list(F.struct("top", "x0", "text", "x1", "bottom")).alias("words")
    return page_lines(words.filter("text is not null").groupBy("page_id").agg(own), gap)


def spanned_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines (page_id, line, text, ...) with char_start and char_end in their page's text (page_id, page_text).

    Numbers keep their gaps: a line of blanks alone has a number but no row. A page's lines, which its paper bounds, are
    taken in order, so of equal lines each finds its own place; a line that isn't in the text has none.
    """
    full = lines.withColumn("text", F.trim("text")).filter("text <> ''")
    rest = [c for c in full.columns if c not in ("page_id", "line", "text")]
    own = full.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line", "text", *rest))).alias("_l"))
    texts = pages.select(F.col("page_id").alias("_p"), F.col("page_text").alias("_text"))
    found = own.join(texts, F.col("page_id") == F.col("_p"), "left").select("page_id", F.explode(F.arrays_zip(F.col("_l").alias("l"), line_spans(F.transform("_l", lambda x: x["text"]), F.col("_text")).alias("span"))).alias("_s"))
    return found.select(*[F.col(c) if c == "page_id" else F.col(f"_s.l.{c}") for c in full.columns], F.col("_s.span.start").alias("char_start"), F.col("_s.span.stop").alias("char_end"))

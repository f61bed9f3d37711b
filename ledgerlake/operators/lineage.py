"""Chunks with their parents, embeddings that are fresh or stale, summaries, selections, and ordered sets of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlake.functions.text import context_period, decimal_text, rough_tokens


def chunk_lineage(chunks: DataFrame, sections: DataFrame, versions: DataFrame, documents: DataFrame, companies: DataFrame) -> DataFrame:
    """Chunks with section, version and document, and with the company where there is one.

    Equi-joins on the parents' ids; AQE broadcasts a parent whose measured size is under its threshold.
    """
    return chunks.join(sections, "section_id").join(versions, "version_id").join(documents, "document_id").join(companies, "company_id", "left")


def fresh_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with an embedding of the text that they have now."""
    return chunks.join(embeddings, ["chunk_id", "content_hash"])


def stale_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ids of embeddings whose chunk's text has changed since."""
    old = embeddings.select("chunk_id", F.col("content_hash").alias("_had"))
    return chunks.join(old, "chunk_id").filter("content_hash <> _had").select("chunk_id")


def summaries_of(summaries: DataFrame, versions: DataFrame, sections: DataFrame | None = None, codes: tuple[str, ...] = ()) -> DataFrame:
    """Summaries with their version; with codes, only of versions that have such a section (a semi-join, so none repeats)."""
    found = summaries.join(versions, "version_id")
    return found.join(sections.filter(F.col("section_code").isin(list(codes))), "version_id", "left_semi") if codes else found


def first_summary(summaries: DataFrame, parent: str) -> DataFrame:
    """One summary a parent: the oldest, then the smaller id."""
    return summaries.groupBy(parent).agg(F.min_by("summary", F.struct("created_at", "summary_id")).alias("summary"))


def current_versions(versions: DataFrame, tickers: DataFrame, symbols: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """Current versions of the companies with such tickers, newest filing first."""
    wanted = tickers.filter(F.upper("symbol").isin([s.strip().upper() for s in symbols])).select("company_id")
    return versions.filter(F.col("is_current") & F.col("kind").isin(list(kinds))).join(wanted, "company_id", "left_semi").orderBy(F.desc_nulls_last("filing_date"), "version_id")


def selected_documents(versions: DataFrame, kinds: tuple[str, ...], most: int) -> DataFrame:
    """The `most` current versions that were filed last: a top-k."""
    return versions.filter(F.col("is_current") & F.col("kind").isin(list(kinds))).orderBy(F.desc_nulls_last("filing_date"), "version_id").limit(most)


def chunks_to_index(chunks: DataFrame, most: int | None = None, version_ids: tuple = ()) -> DataFrame:
    """Chunks in order of creation, of the versions named if any are."""
    rows = chunks.filter(F.col("version_id").isin(list(version_ids))) if version_ids else chunks
    return rows.orderBy("created_at", "chunk_id").limit(most) if most else rows.orderBy("created_at", "chunk_id")


def looked_up(ranked: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of ranked chunks, in rank order; chunks without a key are left out."""
    return ranked.join(keys, "chunk_id").orderBy("rank")


def indexed_chunks(decided: DataFrame, section: str, order: str) -> DataFrame:
    """Chunks kept, numbered from 0 within their section."""
    return decided.filter("kept").withColumn("chunk_index", F.row_number().over(W.partitionBy(section).orderBy(order)) - 1)


def section_ends(sections: DataFrame, document: str, start: str, length: str) -> DataFrame:
    """Each section ends where the next one of its document starts, the last with the text."""
    return sections.withColumn("stop", F.coalesce(F.lead(start).over(W.partitionBy(document).orderBy(start)), F.col(length)))


def last_by_id(parts: list[DataFrame], key: str = "evidence_id") -> DataFrame:
    """The union of the parts with one row a key: that of the last part, and in it the one with the largest position."""
    union = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        union = part if union is None else union.unionByName(part)
    rest = [c for c in union.columns if c not in (key, "_part")]
    best = union.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_part", "position")).alias("_b"))
    return best.select(key, "_b.*").orderBy(key)


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, in order of its first place."""
    return rows.groupBy(value).agg(F.min(order).alias("first_place")).orderBy("first_place")


def sufficient(have: Column, needed: Column) -> Column:
    """Whether all that is needed is there; null sets are empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(needed, none), F.coalesce(have, none))) == 0


def deferred_last(ranked: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Rows in rank order, but what is over `most` of its group after all others; final places from 1 within `lane`."""
    rn = F.row_number().over(W.partitionBy("lane", group).orderBy(order))
    flagged = ranked.withColumn("deferred", rn > most)
    return flagged.withColumn("place", F.row_number().over(W.partitionBy("lane").orderBy("deferred", order)))


def newest_facts(facts: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """One fact of each key, the one with the smallest id, and of them the newest."""
    rest = [c for c in facts.columns if c not in keys]
    one = facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), "fact_id").alias("_f")).select(*keys, "_f.*")
    return one.orderBy(F.desc("period_end"), "fact_id").limit(most)


def fact_evidence(facts: DataFrame) -> DataFrame:
    """Facts as evidence for a context: label, content, period and rough tokens."""
    told = F.concat_ws(" ", F.col("company_name"), F.concat("metric", F.lit(":")), decimal_text(F.col("value")), F.col("unit"), F.concat(F.lit("("), "period_type", F.lit(" ending "), F.col("period_end").cast("string"), F.lit(")")))
    named = facts.select(F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("label"), F.lit("financial_fact").alias("kind"), "company_id", context_period(F.col("fiscal_year"), F.col("fiscal_period")).alias("period"), told.alias("content"))
    return named.withColumn("tokens", rough_tokens("content"))


def macro_used(macro: DataFrame, dates: DataFrame, date: str = "observed_at") -> DataFrame:
    """Macro rows that are the latest known at some date of a calculation.

    A row is used if a date lies from its own up to, not including, its series' next one. The first date at or after
    each day that macro rows have is found over distinct calendar days alone, and joined by equality.
    """
    asked = dates.select(F.col(date).alias("_day"), F.col(date).alias("_asked")).filter("_day is not null").distinct()
    days = macro.select(F.col(date).alias("_day"), F.lit(None).cast(dates.schema[date].dataType).alias("_asked")).distinct().unionByName(asked)
    onwards = W.orderBy(F.desc("_day")).rangeBetween(W.unboundedPreceding, 0)  # a row or two a calendar day
    first = days.select("_day", F.min("_asked").over(onwards).alias("_first")).distinct()
    points = macro.select("series_id", date).distinct()
    after = F.lead(date).over(W.partitionBy("series_id").orderBy(date))
    used = points.withColumn("_next", after).join(first, F.col(date) == F.col("_day")).filter((F.col("_first") < F.col("_next")) | (F.col("_first").isNotNull() & F.col("_next").isNull()))
    return macro.join(used.select("series_id", date), ["series_id", date], "left_semi")

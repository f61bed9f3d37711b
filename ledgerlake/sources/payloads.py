"""Parsers of JSON payloads: ticker maps, submissions, company facts and macro series, as DataFrames.

A payload is one row with the text in column `payload`; read files with spark.read.text(path, wholetext=True).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ledgerlake.functions.text import filing_url
from ledgerlake.operators.facts import classify_period, source_hash

OBSERVATION = "struct<start:string,end:string,val:decimal(28,6),accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
FACTS = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<label:string,units:map<string,array<{OBSERVATION}>>>>>>"
RECENT = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
MISSING = ("", ".", "NaN", "nan")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def ticker_map(payloads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ticker, cik, title): upper case, ten digits; a later row of one ticker wins within the keys."""
    keys = keys or []
    rows = payloads.select(*keys, F.explode(F.from_json("payload", "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("k", "v"))
    plain = rows.select(*keys, F.col("k").cast("long").alias("pos"), F.upper("v.ticker").alias("ticker"), F.lpad("v.cik_str", 10, "0").alias("cik"), F.col("v.title").alias("title"))
    return plain.groupBy(*keys, "ticker").agg(F.max_by(F.struct("cik", "title"), "pos").alias("r")).select(*keys, "ticker", "r.*")


def recent_filings(payloads: DataFrame, forms: tuple[str, ...], per_form: int) -> DataFrame:
    """The first filings of each form in input order; rows without accession or document don't count."""
    kind = "struct<cik:string,filings:struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in RECENT) + ">>>"
    doc = payloads.select(F.from_json("payload", kind).alias("d"))
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"d.filings.recent.{n}"), F.array().cast("array<string>")).alias(n) for n in RECENT])
    rows = doc.select(F.lpad("d.cik", 10, "0").alias("cik"), F.posexplode(zipped).alias("pos", "r")).select("cik", "pos", "r.*")
    rows = rows.filter(F.col("form").isin(*forms) & (F.coalesce("accessionNumber", F.lit("")) != "") & (F.coalesce("primaryDocument", F.lit("")) != ""))
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("cik", "form").orderBy("pos")))
    return ranked.filter(F.col("rn") <= per_form).select("cik", "form", F.col("accessionNumber").alias("accession_number"), F.try_to_date("filingDate").alias("filing_date"), F.try_to_date("reportDate").alias("report_date"), F.col("primaryDocument").alias("document"), "pos")


def metric_of(mapping: dict, cik: Column, taxonomy: Column, concept: Column) -> Column:
    """The metric of a concept: the company's own mapping first, then the global one."""
    pairs = [(t, c, m) for m, by in mapping.get("metrics", {}).items() for t, concepts in by.items() for c in concepts]
    own = [(k, t, c, m) for k, metrics in mapping.get("company_overrides", {}).items() for m, by in metrics.items() for t, concepts in by.items() for c in concepts]
    for keys in ([p[:2] for p in pairs], [o[:3] for o in own]):
        if len(keys) != len(set(keys)):
            raise ValueError("a concept is mapped to two metrics")
    look = lambda rows, key: F.try_element_at(F.create_map(*[F.lit(x) for row in rows for x in ("|".join(row[:-1]), row[-1])]), key) if rows else F.lit(None).cast("string")
    return F.coalesce(look(own, F.concat_ws("|", cik, taxonomy, concept)), look(pairs, F.concat_ws("|", taxonomy, concept)))


def company_facts(payloads: DataFrame, mapping: dict) -> DataFrame:
    """All observations of mapped and unmapped concepts; `metric` is null for the latter.

    Observations without a valid end or value go. Dates that can't be read are null.
    """
    doc = payloads.select(F.from_json("payload", FACTS).alias("d"))
    concepts = doc.select(F.lpad("d.cik", 10, "0").alias("cik"), F.col("d.entityName").alias("entity"), F.explode("d.facts").alias("taxonomy", "c")).select("cik", "entity", "taxonomy", F.explode("c").alias("concept", "body"))
    concepts = concepts.withColumn("metric", metric_of(mapping, F.col("cik"), F.col("taxonomy"), F.col("concept")))
    rows = concepts.select("cik", "entity", "taxonomy", "concept", "metric", F.col("body.label").alias("label"), F.explode("body.units").alias("unit", "o")).select("*", F.posexplode("o").alias("pos", "x")).drop("o")
    start, end = F.try_to_date("x.start"), F.try_to_date("x.end")
    plain = rows.filter(end.isNotNull() & F.col("x.val").isNotNull()).select(
        "cik", "entity", "taxonomy", "concept", "metric", "label", "unit", "pos", start.alias("period_start"), end.alias("period_end"), F.col("x.val").alias("value"),
        F.col("x.accn").alias("accession_number"), F.col("x.fy").alias("fiscal_year"), F.col("x.fp").alias("fiscal_period"), F.col("x.form").alias("form"), F.try_to_date("x.filed").alias("filed_date"),
        classify_period(start, end, F.col("x.fp")).alias("period_type"), F.coalesce(F.col("x.form").endswith("/A"), F.lit(False)).alias("is_amendment"),
    )
    identity = {k: F.col(k) for k in ("cik", "taxonomy", "concept", "unit", "period_start", "period_end", "value", "accession_number", "fiscal_year", "fiscal_period", "form", "filed_date")}
    return plain.withColumns({"source_hash": source_hash(identity), "source_url": filing_url(F.col("cik"), F.col("accession_number"), F.lit(""))})


def unmapped_concepts(payloads: DataFrame, mapping: dict) -> DataFrame:
    doc = payloads.select(F.from_json("payload", FACTS).alias("d")).select(F.lpad("d.cik", 10, "0").alias("cik"), F.explode("d.facts").alias("taxonomy", "c"))
    return doc.select("cik", "taxonomy", F.explode(F.map_keys("c")).alias("concept")).filter(metric_of(mapping, F.col("cik"), F.col("taxonomy"), F.col("concept")).isNull())


def observations_of(rows: DataFrame, series: Column, payload: str = "observations") -> DataFrame:
    """Observations of many series, a payload each; the usual marks of a missing value become null."""
    each = rows.select(series.alias("series_id"), F.explode(F.from_json(payload, "struct<observations:array<struct<realtime_start:string,realtime_end:string,date:string,value:string>>>")["observations"]).alias("o"))
    return each.select(
        "series_id", F.try_to_date("o.date").alias("observed_at"), F.try_to_date("o.realtime_start").alias("realtime_start"), F.try_to_date("o.realtime_end").alias("realtime_end"),
        F.when(F.col("o.value").isin(*MISSING), None).otherwise(F.col("o.value").try_cast("decimal(38,12)")).alias("value"),
    )


def macro_observations(payloads: DataFrame, series_id: str) -> DataFrame:
    """Observations of one series."""
    return observations_of(payloads, F.lit(series_id), "payload")


def macro_metadata(payloads: DataFrame) -> DataFrame:
    names = ("id", "title", "observation_start", "observation_end", "frequency", "frequency_short", "units", "units_short", "seasonal_adjustment", "last_updated")
    rows = payloads.select(F.explode(F.from_json("payload", "struct<seriess:array<struct<" + ",".join(f"{n}:string" for n in names) + ">>>")["seriess"]).alias("s")).select("s.*")
    return rows.select(F.upper("id").alias("series_id"), "title", F.try_to_date("observation_start").alias("observation_start"), F.try_to_date("observation_end").alias("observation_end"), "frequency", F.col("units_short").alias("unit"), "seasonal_adjustment", "last_updated")


def archive_exhibits(payloads: DataFrame, primary: str) -> DataFrame:
    """Files of a directory listing whose type begins with EX- or EX_, without the primary document."""
    rows = payloads.select(F.explode(F.from_json("payload", "struct<directory:struct<item:array<struct<name:string,type:string>>>>")["directory"]["item"]).alias("i")).select("i.*")
    return rows.filter((F.upper("type").startswith("EX-") | F.upper("type").startswith("EX_")) & (F.col("name") != primary))


def load_yaml(text: str) -> dict:
    """A mapping or manifest file; the text comes from whole_files(), so any store that Spark reads will do."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("the file must hold a mapping")
    return found


def pdf_manifest(spark: SparkSession, manifest: dict) -> DataFrame:
    """Rows of a manifest of PDF documents; the CIK has ten digits; missing fields and repeated ids are errors."""
    rows, seen = [], set()
    for item in manifest.get("documents") or []:
        for name in ("id", "company_name", "title", "document_type", "url"):
            if not item.get(name):
                raise ValueError(f"a document lacks {name}")
        if item["id"] in seen:
            raise ValueError(f"two documents have the id {item['id']}")
        seen.add(item["id"])
        rows.append((str(item["id"]), item["company_name"], item.get("ticker"), str(item["cik"]).zfill(10) if item.get("cik") else None, item["title"], item["document_type"], item.get("fiscal_year"), item.get("fiscal_period"), str(item["period_end"]) if item.get("period_end") else None, item["url"]))
    return spark.createDataFrame(rows, "id string, company_name string, ticker string, cik string, title string, document_type string, fiscal_year int, fiscal_period string, period_end string, url string").withColumn("period_end", F.try_to_date("period_end"))

"""Ingestion runs over many payloads at once, artifacts by content, sections, run events and feedback."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ledgerlake.functions.text import preview
from ledgerlake.operators.facts import insert_new
from ledgerlake.session import stored
from ledgerlake.sources.payloads import company_facts, unmapped_concepts


@F.pandas_udf(T.StringType())
def pretty_json(payload: pd.Series) -> pd.Series:
    """JSON with sorted keys and an indent of two; null where it can't be read."""

    def shown(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), indent=2, sort_keys=True)
        except json.JSONDecodeError:
            return None

    return payload.map(shown)


def artifacts(rows: DataFrame, held: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, content_hash, size_bytes, content) of artifacts to write: those whose path doesn't hold the same bytes yet.

    `held` has path and content_hash. Of several rows of a path in the batch the one with the largest hash is written.
    """
    body = F.col(content).cast("binary")
    own = rows.select(F.col(path).alias("path"), F.sha2(body, 256).alias("content_hash"), F.octet_length(body).cast("long").alias("size_bytes"), body.alias("content"))
    one = own.groupBy("path").agg(F.max_by(F.struct("content_hash", "size_bytes", "content"), "content_hash").alias("_a")).select("path", "_a.*")
    return one.join(held.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("path", "content_hash", "size_bytes", "content")


def facts_run(payloads: DataFrame, mapping: dict, held: DataFrame, item: str = "ticker") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts to append, failures, run): one run over the payloads of many companies.

    A payload that is missing or no JSON object with facts fails alone, as a row (item, stage, message); the others go on. The
    run is one row of counters, and its status is `success` or `partial_failed`. `held` has the source_hash of facts.
    """
    parsed = F.try_parse_json(F.col("payload"))
    whole = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.facts", "variant")).startswith("OBJECT"), F.lit(False))
    rows = stored(payloads.withColumn("_ok", whole))
    failures = rows.filter("not _ok").select(F.col(item).alias("item"), F.lit("company_facts").alias("stage"), F.when(F.col("payload").isNull(), "no payload").otherwise("payload has no facts").alias("message"))
    good = rows.filter("_ok").select("payload")
    found = stored(company_facts(good, mapping))
    fresh, counts = insert_new(held, found.filter("metric is not null"))
    seen = rows.agg(F.count_if("_ok").alias("companies_seen"), F.count_if(~F.col("_ok")).alias("failures"))
    unmapped = unmapped_concepts(good, mapping).agg(F.count(F.lit(1)).alias("unmapped_concepts"))
    run = seen.crossJoin(counts).crossJoin(unmapped)  # one row each
    status = F.when(F.col("failures") == 0, "success").otherwise("partial_failed")
    return fresh, failures, run.select(status.alias("status"), "companies_seen", (F.col("inserted") + F.col("duplicates")).alias("facts_seen"), F.col("inserted").alias("facts_inserted"), F.col("duplicates").alias("duplicates_skipped"), "unmapped_concepts", "failures")


def upsert_sections(held: DataFrame, detected: DataFrame, keys: tuple[str, ...] = ("version_id", "section_key")) -> DataFrame:
    """Sections after a detection: found ones as they are now, others as they were; none is ever deleted."""
    rest = [c for c in held.columns if c not in keys]
    both = held.select(*keys, F.lit(0).alias("_side"), F.struct(*rest).alias("_s")).unionByName(detected.select(*keys, F.lit(1).alias("_side"), F.struct(*rest).alias("_s")))
    return both.groupBy(*keys).agg(F.max_by("_s", F.struct("_side", "_s")).alias("_s")).select(*keys, "_s.*").select(*held.columns)


def pdf_sections(pages: DataFrame, key: str = "version_id", page: str = "page", text: str = "text") -> DataFrame:
    """(key, section_text, page_start, page_end): a document's pages that hold text, joined by empty lines; its paper bounds them."""
    own = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    full = pages.withColumn("_t", own).filter("_t <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_t").alias("t")))), lambda x: x["t"]), "\n\n")
    return full.groupBy(key).agg(joined.alias("section_text"), F.min(page).alias("page_start"), F.max(page).alias("page_end"))


def candidate_diagnostics(decisions: DataFrame, version: str = "version") -> DataFrame:
    """(version, diagnostics): how many candidates a version had and what became of them, as JSON."""
    n = lambda said: F.count_if(F.col("decision") == said)
    told = F.to_json(F.struct(F.count(F.lit(1)).alias("candidates"), n("kept").alias("kept"), n("near_copy").alias("near_copies"), n("boilerplate").alias("boilerplate")))
    return decisions.groupBy(version).agg(told.alias("diagnostics"))


def cleared(outputs: dict[str, DataFrame], versions: DataFrame, key: str = "version_id") -> dict[str, DataFrame]:
    """What is left of each table of outputs (embeddings, chunks, summaries) once those of the versions are cleared.

    The versions' keys are hashed and outputs stream past them: sorting would hold a partition's outputs, which shrink when
    they are shuffled, so partitions of a fixed size hold ever more of them.
    """
    gone = versions.select(key).distinct().hint("shuffle_hash")
    return {name: rows.join(gone, key, "left_anti") for name, rows in outputs.items()}


def demo_chunks(chunks: DataFrame, limit: int = 5) -> DataFrame:
    """The first chunks of the newest documents, in order of section and place, with a preview of their text."""
    first = chunks.orderBy(F.desc("created_at"), "ordinal_path", "chunk_index", "chunk_id").limit(limit)
    return first.select("chunk_id", "title", "kind", "ordinal_path", "chunk_index", "tokens", preview("text").alias("text"))


def paced(requests: DataFrame, per_second: float = 9.0, client: str = "client", at: str = "at", order: str = "request_id") -> DataFrame:
    """The requests with `starts`, in seconds: each at its time, but a client's no closer than 1 / per_second.

    A start is the larger of the arrival and the start before plus the interval, which is a running maximum of the
    arrivals less their places' intervals.
    """
    step = F.lit(1.0 / per_second if per_second > 0 else 0.0)
    own = W.partitionBy(client).orderBy(at, order)
    place = F.row_number().over(own)
    rows = requests.withColumn("_free", F.col(at).cast("double") - place * step).withColumn("_place", place)
    return rows.withColumn("starts", F.max("_free").over(own.rowsBetween(W.unboundedPreceding, 0)) + F.col("_place") * step).drop("_free", "_place")


def task_events(tasks: DataFrame) -> DataFrame:
    """(run_id, event_key, event_type, status, node, branch_id, attempt, summary, duration_ms) of tasks' starts and ends.

    `tasks`: run_id, task_id, node, branch_id, kind, attempt, status (null while it runs), summary, error, duration_ms.
    A task with a branch that reads or computes also starts a tool. A failed task without summary gets a fixed one.
    """
    key = lambda kind, said: F.concat(F.lit(f"{kind}:"), F.col("task_id"), F.lit(f":{said}"))
    none = F.lit(None).cast("string")
    event = lambda k, kind, status, summary, took: F.struct(k.alias("event_key"), F.lit(kind).alias("event_type"), status.alias("status"), summary.alias("summary"), took.alias("duration_ms"))
    untimed = F.lit(None).cast("long")
    closing = F.coalesce("summary", F.when(F.col("error").isNotNull(), "Execution step failed.").otherwise("Execution step completed."))
    ended = F.coalesce("status", F.when(F.col("error").isNotNull(), "failed"))
    made = F.array(
        event(key("node", "started"), "node.status", F.lit("started"), none, untimed),
        F.when(F.col("branch_id").isNotNull() & (F.col("kind") != "chart"), event(key("tool", "started"), "tool.status", F.lit("started"), none, untimed)),
        F.when(ended.isNotNull(), event(key("node", "finished"), "node.status", ended, closing, F.col("duration_ms"))),
    )
    return tasks.select("run_id", "node", "branch_id", "attempt", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("run_id", "e.*", "node", "branch_id", "attempt")


def append_feedback(runs: DataFrame, feedback: DataFrame, now) -> DataFrame:
    """Feedback rows to append: those of runs that exist, with an id of their content and the time."""
    ident = F.sha2(F.concat_ws("\n", "run_id", F.col("rating").cast("string"), F.coalesce("comment", F.lit("")), F.coalesce("actor_id", F.lit("")), F.lit(str(now))).cast("binary"), 256)
    return feedback.join(runs.select("run_id").distinct(), "run_id", "left_semi").select(ident.alias("feedback_id"), "run_id", "rating", "comment", "actor_id", F.lit(now).alias("created_at"))


def retrieval_warnings(chunks: DataFrame, candidates: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """(by, warning) rows of retrievals: chunks without any indexed vector, or none among the dense candidates."""
    tagged = lambda rows, kind, held: rows.select(*by, F.lit(kind).alias("_kind"), held.alias("_held"))
    every = tagged(chunks, "c", F.lit(True)).unionByName(tagged(index, "i", F.lit(True))).unionByName(tagged(candidates, "d", F.col("dense_rank").isNotNull()))
    n = every.groupBy(*by).agg(*[F.count_if((F.col("_kind") == kind) & F.col("_held")).alias(kind) for kind in "cid"])
    told = F.array(F.when((F.col("c") > 0) & (F.col("i") == 0), F.lit("missing_embedding_index")), F.when((F.col("i") > 0) & (F.col("d") == 0), F.lit("missing_dense_candidates")))
    return n.select(*by, F.explode(F.filter(told, lambda w: w.isNotNull())).alias("warning"))


def chunk_evidence(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks as evidence for a context: label, kind, ids, period, content and tokens, in final order."""
    period = F.when(F.col("fiscal_year").isNotNull() & F.col("fiscal_period").isNotNull(), F.concat_ws(":", F.col("fiscal_year").cast("string"), "fiscal_period")).otherwise(F.col("fiscal_year").cast("string"))
    body = chunks.select(F.col("chunk_id").cast("string").alias("_id"), "company_id", "document_id", "section_id", period.alias("period"), F.col("text").alias("content"), "tokens")
    return chosen.join(body, F.col("chunk_id") == F.col("_id")).select(F.concat(F.lit("chunk:"), "_id").alias("label"), F.lit("chunk").alias("kind"), "company_id", "document_id", "section_id", "period", "content", "tokens", "final_rank")


# Endings that the labels of companies named in questions lose.
LABEL_ENDINGS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "class a", "class b", "common stock")


def company_label(name: str | Column) -> Column:
    """A company's name in lower case, words by one space, without the endings, which may follow each other."""
    own = F.col(name) if isinstance(name, str) else name
    plain = F.trim(F.regexp_replace(F.lower(own), r"(?U)[^\w]+", " "))
    return F.regexp_replace(plain, f"(?: (?:{'|'.join(LABEL_ENDINGS)}))+$", "")


# How many warnings of a result an event shows, and how much of each.
MOST_WARNINGS, MOST_WARNING_CHARS = 10, 240


def result_events(outcomes: DataFrame, observations: DataFrame, warnings: DataFrame) -> DataFrame:
    """(run_id, branch_id, event_key, status, cache_hit, n_observations, series, n_warnings, warnings) of branches' outcomes.

    `outcomes`: run_id, branch_id, kind, status, attempts; `observations`: run_id, branch_id, series; `warnings`: run_id,
    branch_id, place, text. Only a completed branch has a result. All warnings are counted and the first few by place
    shown, cut to size; they are ranked before they are gathered, so tasks keep no more than that of any branch.
    """
    keys = ["run_id", "branch_id"]
    place = F.row_number().over(W.partitionBy(*keys).orderBy("place", "text"))
    first = warnings.withColumn("_n", place).filter(F.col("_n") <= MOST_WARNINGS)
    shown = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.left("text", F.lit(MOST_WARNING_CHARS)).alias("t")))), lambda w: w["t"]).alias("warnings"))
    counted = warnings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_warnings"))
    seen = observations.groupBy(*keys, "series").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n_observations"), F.count("series").alias("series"))
    done = F.col("status") == "completed"
    said = outcomes.join(seen, keys, "left").join(counted, keys, "left").join(shown, keys, "left")
    result = lambda c, none: F.when(done, F.coalesce(c, none)).alias(c)
    zero = F.lit(0).cast("long")
    return said.select(
        *keys, F.concat_ws(":", F.lit("tool"), F.col("branch_id").cast("string"), "status", F.col("attempts").cast("string")).alias("event_key"), "kind", "status", (F.col("attempts") == 0).alias("cache_hit"),
        result("n_observations", zero), result("series", zero), result("n_warnings", zero), result("warnings", F.array().cast("array<string>")),
    )

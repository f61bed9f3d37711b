"""The corpus pipeline: quality rules, quality classifier, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns the columns of
documents; the last returns pieces of packed sequences. run() writes each stage's result to the shared folder and
hands on what it reads back.

Nulls: a null text fails the base rules and goes in the first stage. A row with a null doc_id is judged by its text like
any other; in near-dedup it stays only if no row of its group has a doc_id. Of repeated rows near-dedup keeps one; rows
that share a doc_id but not the text are judged, linked and kept each for itself. Texts are read whole, whatever their
length. Columns besides those of documents are dropped, so clashing names don't matter. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm.classifier import classify
from ledgerlake.llm.packing import crc_of, pack
from ledgerlake.llm.queries import tokenizer
from ledgerlake.llm.rules import labelled, learn, verdict, with_statistics
from ledgerlake.llm.shared import discard, stored
from ledgerlake.llm.simhash import near_copies
from ledgerlake.llm.substring import remove_repeats
from ledgerlake.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't state learned rules, the classifier or fingerprints; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labelled ones among them."""
    labels = table(spark, sf_dir, "labels")
    # statistics are small, so labels meet them and not texts
    measured = stored(with_statistics(docs.select("doc_id", "text")).drop("text"), "measured")
    rules = learn(labelled(measured, labels))
    discard(measured)
    return with_statistics(docs.select(*COLUMNS)).filter(verdict(rules)).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is at least 0.3."""
    rows = docs.select(*COLUMNS, F.col("text").alias("_kept"))  # classify takes the column text for itself
    keep = [c for c in COLUMNS if c != "text"]
    return classify(rows, table(spark, sf_dir, "labels"), keep=(*keep, "_kept")).filter("predicted = 1").select(*[F.col("_kept").alias("text") if c == "text" else F.col(c) for c in COLUMNS])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Rows are told apart by doc_id and the hash of their text; equal ones are drawn together before they move.
    """
    mine = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    found = near_copies(mine, keep=("_hash",)).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "_hash")).alias("_k"))
    rest = [c for c in COLUMNS if c != "doc_id"]
    # one set of plain keys for both, so that texts move once
    known, number = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    single = mine.groupBy(known.alias("_known"), number.alias("_id"), "_hash").agg(F.min(F.struct(*rest)).alias("_row"))
    own = kept.select("_k.*").select(known.alias("_known"), number.alias("_id"), "_hash")
    doc_id = F.when(F.col("_known"), F.col("_id")).alias("doc_id")
    return single.join(own, ["_known", "_id", "_hash"]).select(doc_id, *[F.col(f"_row.{c}").alias(c) for c in rest])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a text that holds none stays as it is."""
    done = remove_repeats(docs, keep=COLUMNS)
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))
    return done.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ids of all documents, in sequences of at most 2048, mixed by source."""
    return crc_of(pack(docs, tokenizer()))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

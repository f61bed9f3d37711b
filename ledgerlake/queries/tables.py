"""SQL text that calls the engine's table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.catalogue import ORACLES, query
from ledgerlake.functions.tables import register
from ledgerlake.queries.claims import answers
from ledgerlake.session import table


@query("c1_claims_by_sql", ORACLES["c1_c2_claims"])
def claims(spark, sf):
    register(spark)
    return spark.sql("SELECT a.answer_id, c.sentence_index, c.text, c.claim_id, array_join(c.evidence_ids, ',') AS cited, c.material FROM {a} a, LATERAL claims(a.answer) c", a=answers(spark, sf))


@query("d5_chunks_by_sql")
def chunks(spark, sf):
    """Tests compare with the DataFrame form."""
    register(spark)
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.char_start, c.char_end, c.text, c.tokens FROM {d} d, LATERAL chunks(d.text, 320, 40) c", d=table(spark, sf, "documents").select("doc_id", "text"))


def reports(spark, sf):
    """Every document as the body of two items of a report."""
    said = lambda x: F.lit(f" {x} ")
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.concat(said("Item 1A. Risk Factors"), body, said("Item 7. Management's Discussion and Analysis"), body, said("Item 8. Statements")).alias("text"))


@query("s15_sections_by_sql")
def sections(spark, sf):
    """Tests compare with the DataFrame form."""
    register(spark)
    return spark.sql("SELECT r.doc_id, s.* FROM {r} r, LATERAL sections(r.text) s", r=reports(spark, sf))

"""Table functions for SQL: chunks, claims and sections of a text, beside the rows they come from.

    register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 320, 40) c

Rows come out of a task as they are made, a hundred at a time; by Arrow each input row would be a table of its own, and a batch of ten thousand whole. A null text is empty: it has no claims or sections, and no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ledgerlake.functions.udfs import sections_of, single_blanks
from ledgerlake.operators.claims import claims_of
from ledgerlake.operators.documents import packed_chunks


class Chunks:
    def eval(self, text: str | None, most: int, overlap: int) -> Iterator[tuple]:
        for i, chunk in enumerate(packed_chunks(text or "", most, overlap)):
            yield i, *chunk


class Claims:
    def eval(self, answer: str | None) -> Iterator[tuple]:
        for c in claims_of(answer):
            yield c["claim_id"], c["text"], c["evidence_ids"], c["material"], c["sentence_index"]


class Sections:
    def eval(self, text: str | None) -> Iterator[tuple]:
        for s in sections_of(single_blanks(text)) if text is not None else []:
            yield s["section_key"], s["title"], s["start"], s["stop"], s["text_hash"]


FUNCTIONS = {
    "chunks": (Chunks, "chunk_index bigint, char_start bigint, char_end bigint, text string, tokens bigint"),
    "claims": (Claims, "claim_id string, text string, evidence_ids array<string>, material boolean, sentence_index bigint"),
    "sections": (Sections, "section_key string, title string, start bigint, stop bigint, text_hash string"),
}


def register(spark: SparkSession) -> None:
    for name, (made, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=schema, useArrow=False))

"""The queries of this subpackage and of corpus_pipeline.py, with their SQL."""

from __future__ import annotations

import corpus_pipeline

from ledgerlake.llm import queries as llm_queries


def queries() -> dict:
    return dict(llm_queries.QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(llm_queries.ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

"""Importing this package registers every query of the reference's own operators."""

from ledgerlake.queries import charts, claims, decimals, entities, evaluations, facts, flagship, ingestion, lineage, payloads, plans, runs, searches, sentences, series, stores, streams, tables, texts  # noqa: F401

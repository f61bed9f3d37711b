"""Spark-first analytics engine for public-company research data."""

"""Sinks of reports: JSON with sorted keys, and Markdown tables. Reports are small: metrics, categories and failures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

#: Rows of a report table; more are an error, never dropped.
MOST_ROWS = 10_000


def json_report(report: dict) -> str:
    """The report with sorted keys and two blanks of indent; dates and decimals as text."""
    return json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def rows_of(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """A report table's rows for the driver; a table over the bound is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def markdown_table(columns: list[str], rows: list[dict]) -> str:
    """A Markdown table; bars and line ends in cells are escaped, nulls are a dash."""
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]]) + "\n"


def evaluation_report(metrics: DataFrame, categories: DataFrame, failures: list[str]) -> tuple[str, str]:
    """(JSON, Markdown) of an evaluation: metrics (one row), categories, and what the gate found."""
    found, by = rows_of(metrics)[0], rows_of(categories)
    markdown = "# Evaluation\n\n" + markdown_table(["metric", "value"], [{"metric": k, "value": v} for k, v in sorted(found.items())])
    markdown += "\n## Categories\n\n" + markdown_table(categories.columns, by) + "\n## Gate\n\n" + ("".join(f"- {f}\n" for f in failures) or "passed\n")
    return json_report({"metrics": found, "categories": by, "failures": failures, "passed": not failures}), markdown


def write_json_rows(df: DataFrame, path: str) -> None:
    """All rows as JSON lines with null fields kept, by Spark's writer, to any store it knows."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)

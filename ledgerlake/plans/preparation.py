"""Data made ready when it is asked for: steps for companies that are not ready yet, and series read through a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerlake.operators.macro import missing_series, query_macro
from ledgerlake.plans.requests import MacroRequest


def requested_tickers(tickers: tuple[str, ...]) -> tuple[str, ...]:
    """Upper case, without white space or blanks, each once, in order."""
    return tuple(dict.fromkeys(t.strip().upper() for t in tickers if t.strip()))


def prepare(tickers: tuple[str, ...], ready: Callable[[tuple[str, ...]], set[str]], steps: dict[str, Callable[[tuple[str, ...]], dict[str, int]]]) -> dict:
    """Run the steps (filings, facts, process, index) in order for the tickers that are not ready.

    A step returns counts; one that raises counts each pending ticker as a failure, and the steps after it still run.
    The result names what was asked for, skipped and prepared (ready at the end), with status skipped, completed,
    partial or failed.
    """
    asked = requested_tickers(tickers)
    pending = tuple(t for t in asked if t not in ready(asked)) if asked else ()
    out = {"requested": asked, "skipped": tuple(t for t in asked if t not in pending), "prepared": (), "failures": 0, "errors": [], "counts": {}}
    if not pending:
        return out | {"status": "skipped"}
    for name, step in steps.items():
        try:
            counts = step(pending)
        except Exception as error:  # a step's failure is recorded and must not stop the others
            out["failures"] += len(pending)
            out["errors"].append(f"{name}: {type(error).__name__}")
            continue
        out["failures"] += counts.get("failures", 0)
        out["counts"][name] = counts
    now = ready(pending)
    out["prepared"] = tuple(t for t in pending if t in now)
    status = "completed" if not out["failures"] and len(out["prepared"]) == len(pending) else "partial" if out["prepared"] or out["counts"] else "failed"
    return out | {"status": status}


def read_through(stored: DataFrame, request: MacroRequest, fetch: Callable[[tuple[str, ...]], DataFrame] | None) -> tuple[DataFrame, tuple[str, ...]]:
    """(rows, warnings) of a macro query; series that the store lacks are fetched and queried with the rest.

    `fetch` takes series ids and returns observations; it may raise, which leaves a warning and the stored rows. Without
    it the missing series are only warned of. The ids asked for are few; rows stay distributed.
    """
    spark = stored.sparkSession
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(x.strip().upper() for x in request.series_ids)], "series_id string")
    lacking = tuple(sorted(r.series_id for r in missing_series(stored, wanted).collect()))  # at most the ids asked for
    if not lacking:
        return query_macro(stored, request), ()
    if fetch is None:
        return query_macro(stored, request), tuple(f"series_not_cached:{s}" for s in lacking)
    try:
        fresh = fetch(lacking)
    except Exception:  # the store's rows still answer the query
        return query_macro(stored, request), ("on_demand_ingestion_failed:" + ",".join(lacking),)
    return query_macro(stored.unionByName(fresh.select(*stored.columns)), request), ()

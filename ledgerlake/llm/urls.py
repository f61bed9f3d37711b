"""URL filters: rules by host and path, and a character language-model ratio for the rest.

Two variable-order Markov models of bytes, one of URLs that rules allow and one of those they block, are counted exactly
over all such URLs: every context of up to four bytes with the byte that follows it, as one number. Each order backs
off to the one below: p(byte | context) = (n(context, byte) + strength * p(byte | shorter context)) / (n(context) +
strength), so the bytes after any context sum to one. The model grows with the URLs. Up to MOST entries, some 50 MB, it is
broadcast; a larger one stays a table that the URLs' bytes are joined to, so no entry is lost. A URL's score is the difference of its log likelihoods over its length; the threshold is the one that
separates held-out URLs of both kinds best, from a histogram of fixed size.

Null url or one without "://": host and path empty, no rule, and judged by the model from the bytes there are. If one
kind of URL is missing, what no rule fits is allowed. Repeated rows are judged and counted each. Longer URLs are judged
whole, in memory that follows the longest one. Of thresholds that tie the middle one is taken. An empty table gives no
rows. Columns not named in `keep` are ignored; host, path, rule, ratio and verdict are columns of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlake.llm.shared import slices, stored, texts

#: (verdict, host and path) of each rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Contexts have 0 to ORDERS - 1 bytes.
ORDERS = 5
MOST = 2_000_000
#: How much a byte's probability after a shorter context counts, in bytes seen.
STRENGTH = 2.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("verdict"), F.lit("").alias("rule")))
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = out.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    return out


def keys_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each order and byte: order, context and byte as one number; and how many bytes each URL has.

    A URL's bytes are preceded by start marks and followed by an end mark, which counts as a byte.
    """
    coded = [b"\x02" * ORDERS + x.encode() + b"\x03" for x in batch]
    raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    lengths = np.array([len(x) for x in coded], np.int64)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(place >= ORDERS)
    out = np.empty((ORDERS, len(at)), np.int64)
    context = np.zeros(len(at), np.int64)
    for order in range(ORDERS):
        if order:
            context |= raw[at - order] << 8 * (order - 1)
        out[order] = order << 40 | context << 8 | raw[at]
    return out, lengths - ORDERS


class Markov:
    """Both classes' counts of (order, context, byte), by ascending key; row 1 of the counts is of allowed URLs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, strength: float = STRENGTH):
        order = np.argsort(keys)
        self.keys, self.counts, self.strength = keys[order], counts[:, order].astype(float), strength
        contexts = self.keys >> 8
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = contexts[first]
        self.sums = np.add.reduceat(self.counts, first, axis=1) if len(first) else np.zeros((2, 0))

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """p(byte | context) under both classes, for keys of each order of the same bytes."""
        p = np.full((2, keys.shape[1]), 1 / 256)
        for own in keys:
            distinct, place = np.unique(own, return_inverse=True)
            joint = _looked_up(self.keys, self.counts, distinct)
            alone = _looked_up(self.contexts, self.sums, distinct >> 8)
            p = (joint[:, place] + self.strength * p) / (alone[:, place] + self.strength)
        return p

    def log_ratio(self, batch: list[str]) -> np.ndarray:
        """(log P(url | allowed) - log P(url | blocked)) / bytes."""
        keys, lengths = keys_of(batch)
        if not len(lengths):
            return np.zeros(0)
        logs = np.log(self.probabilities(keys))
        return np.add.reduceat(logs[1] - logs[0], np.cumsum(lengths) - lengths) / lengths


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the keys asked for; 0 for those that aren't there."""
    if not len(keys):
        return np.zeros((2, len(asked)))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[:, at], 0.0)


def counted(labelled: DataFrame) -> DataFrame:
    """(key, allowed, blocked) of (allowed boolean, url string) rows, added up before they move; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url"):
                keys, lengths = keys_of(texts(part, "url"))
                side = np.repeat(np.asarray(part.column(0).to_pylist(), bool), lengths)
                for own in keys:
                    distinct, place = np.unique(own, return_inverse=True)
                    allowed = np.bincount(place[side], minlength=len(distinct))
                    blocked = np.bincount(place[~side], minlength=len(distinct))
                    yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(allowed), pa.array(blocked)], names=["key", "allowed", "blocked"])

    found = labelled.select("allowed", "url").mapInArrow(run, "key long, allowed long, blocked long")
    return stored(found.groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "contexts")


def fitted(counts: DataFrame, most: int = MOST) -> Markov:
    """The model of the most frequent entries, `most` at most; counts of single bytes are always kept. `scorer` never cuts any off."""
    n = F.col("allowed") + F.col("blocked")
    # exact counts up to 1024, then powers of two, so the histogram has a bounded number of rows
    level = F.when(n <= 1024, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long"))
    least, kept = 0, 0
    for row in sorted(counts.filter(F.col("key") >= 1 << 40).groupBy(level.alias("n")).agg(F.count(F.lit(1)).alias("entries")).collect(), reverse=True):
        kept += row["entries"]
        if kept > most:
            least = row["n"] + 1
            break
    table = counts.filter((F.col("key") < 1 << 40) | (level >= least)).toArrow()
    return Markov(np.asarray(table.column("key"), np.int64), np.stack([np.asarray(table.column(c), np.int64) for c in ("blocked", "allowed")]))


def with_ratio(rows: DataFrame, model: Markov, url: str = "url", name: str = "ratio") -> DataFrame:
    keep = [f for f in rows.schema.fields if f.name != name]
    schema = T.StructType([*keep, T.StructField(name, T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded: MOST entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, url):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.log_ratio(texts(part, url)), pa.float64())], names=[f.name for f in schema.fields])

    return rows.select(*[f.name for f in keep]).mapInArrow(run, schema)


def with_joined_ratio(rows: DataFrame, counts: DataFrame, url: str = "url", name: str = "ratio") -> DataFrame:
    """As `with_ratio` by all entries, however many: each byte of the distinct URLs meets its entry and its context's sums by key."""
    asked = stored(rows.select(F.coalesce(url, F.lit("")).alias("_url")).distinct().withColumn("_u", F.monotonically_increasing_id()), "urls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_url"):
                keys, lengths = keys_of(texts(part, "_url"))
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                of = np.repeat(np.asarray(part.column(1), np.int64), lengths)
                for own in keys:
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(place), pa.array(own)], names=["_u", "_place", "key"])

    held = asked.mapInArrow(run, "_u long, _place long, key long").withColumn("_context", F.shiftright("key", 8))
    sums = counts.groupBy(F.shiftright("key", 8).alias("_context")).agg(F.sum("allowed").alias("_allowed"), F.sum("blocked").alias("_blocked"))
    met = held.join(counts, "key", "left").join(sums, "_context", "left")
    cells = {f"{c}{k}": F.coalesce(F.sum(F.when(F.shiftright("key", 40) == k, F.col(c))), F.lit(0)) for c in ("allowed", "blocked", "_allowed", "_blocked") for k in range(ORDERS)}
    byte = met.groupBy("_u", "_place").agg(*[cell.alias(c) for c, cell in cells.items()])

    def log_p(side: str) -> Column:
        p = F.lit(1 / 256)
        for k in range(ORDERS):
            p = (F.col(f"{side}{k}") + STRENGTH * p) / (F.col(f"_{side}{k}") + STRENGTH)
        return F.log(p)

    logs = byte.select("_u", F.struct("_place", (log_p("allowed") - log_p("blocked")).alias("log")).alias("_l"))
    of_url = logs.groupBy("_u").agg(F.array_sort(F.collect_list("_l")).alias("_l"))  # as many as the URL has bytes
    ratio = F.reduce("_l", F.lit(0.0), lambda total, x: total + x["log"]) / F.size("_l")
    found = asked.join(of_url.select("_u", ratio.alias(name)), "_u").drop("_u")
    return rows.drop(name).join(found, F.coalesce(rows[url], F.lit("")) == found["_url"]).drop("_url")


def scorer(counts: DataFrame, most: int = MOST) -> Callable[[DataFrame], DataFrame]:
    """What gives rows with a url their ratio, by every entry counted: broadcast up to `most` of them, else joined."""
    if counts.count() <= most:
        model = fitted(counts, most)
        return lambda rows: with_ratio(rows, model)
    return lambda rows: with_joined_ratio(rows, counts)


def calibrated(scored: DataFrame, bins: int = 400, span: float = 4.0) -> float:
    """The threshold with the best mean of both classes' shares judged right, on URLs the model didn't count."""
    slot = F.least(F.greatest(F.floor((F.col("ratio") + span) * bins / (2 * span)), F.lit(0)), F.lit(bins - 1))
    rows = scored.groupBy(slot.cast("int").alias("slot")).agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")).collect()
    table = np.zeros((2, bins))
    for row in rows:
        table[:, row["slot"]] = row["a"], row["b"]
    if not table.sum(1).all():
        return 0.0
    shares = table / table.sum(1)[:, None]
    right = np.concatenate([[1.0], 1 - np.cumsum(shares[0])]) + np.concatenate([[0.0], np.cumsum(shares[1])])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best[len(best) // 2] * 2 * span / bins - span)  # the middle of the best thresholds


def judge(pages: DataFrame, rules: tuple = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), most: int = MOST) -> DataFrame:
    """(keep columns, host, path, rule, ratio, verdict) of every row."""
    rows = pages.select(*keep, F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.filter("_rule is not null").select((F.col("_rule.verdict") == "allow").alias("allowed"), "url")
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    counts = counted(labelled.filter(fold != 0))
    score = scorer(counts, most)
    seen = counts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    threshold = calibrated(score(labelled.filter(fold == 0))) if seen["allowed"] and seen["blocked"] else float("-inf")
    scored = score(rows.withColumn("url", F.coalesce("url", F.lit(""))))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    return scored.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), "ratio", verdict.alias("verdict"))

"""Learned decision lists over document statistics, in DataFrame operations only.

Statistics are built-in functions. Learning is sequential covering: a rule for rejected documents grows one threshold
condition at a time by the information gained on two thirds of the labelled rows, is pruned back on the other third,
and the rows it covers leave. Every count is one aggregation over all labelled rows, binned at quantiles, so the
driver sees counts a bin and no rows. The list becomes one ordered conditional expression.

Null or empty text: no words, so it fails the base rules. Texts of any length are judged whole. Repeated label rows
count once, with the lower quality; repeated documents are judged each and learned from each. Labels that are null or
neither 0 nor 1 are left out, and a document with a null doc_id has none. Of conditions that gain the same the first by
feature and threshold is taken. Without labels of both kinds no rule is learned and all that passes the base rules is
kept. An empty table gives no rows. Columns of the input that have the name of a statistic (n_words to base_failed, and
FEATURES) or _s are replaced by it; `kept` is a column of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.llm.shared import stored

SPLIT = "[\\x20\\x09-\\x0D]+"
FEATURES = ("symbol_share", "shout_share", "repeat_share", "dup_line_share", "mean_word", "n_words", "words_per_line")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text: equal hashes are neighbours once sorted."""
    marks = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twice = lambda k: F.when(((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])), s[k]["i"])
        return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), last), twice), lambda x: x.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(_let(F.sort_array(marks), starts), start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    return F.when(F.size(words) >= 3, total).otherwise(0).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the statistics the rules use, n_words to base_failed among them."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(plain, SPLIT), lambda w: w != "")
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeats(w).alias("repeats")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")))
    stats = F.struct(
        of_words.alias("w"), of_lines.alias("l"),
        F.length(F.regexp_replace(plain, "[^#*$%&|<>]+", "")).cast("long").alias("symbols"),
        F.length(F.regexp_replace(plain, "[^A-Z!]+", "")).cast("long").alias("shouts"),
    )
    n, chars = F.col("_s.w.n"), F.greatest(F.col("_s.w.chars"), F.lit(1))
    some = F.greatest(n, F.lit(1))
    return docs.withColumn("_s", stats).withColumns({
        "n_words": n, "word_chars": F.col("_s.w.chars"), "n_symbols": F.col("_s.symbols"), "n_dup_lines": F.col("_s.l.dups"), "n_repeat_words": F.col("_s.w.repeats"),
        "symbol_share": F.col("_s.symbols") / chars, "shout_share": F.col("_s.shouts") / chars, "repeat_share": F.col("_s.w.repeats") / some,
        "dup_line_share": F.col("_s.l.dups") / F.greatest(F.col("_s.l.n"), F.lit(1)), "mean_word": F.col("_s.w.chars") / some,
        "words_per_line": n / F.greatest(F.col("_s.l.n"), F.lit(1)),
        "base_failed": (n < 50) | (100 * F.col("_s.w.repeats") > 50 * n),
    }).drop("_s")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition.column()
    return out


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled rows that pass the base rules, with `bad` and the part that grows or prunes."""
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 0).alias("bad"))
    return stats.join(marks, F.col("doc_id") == F.col("_id")).filter("not base_failed").select("bad", (F.pmod(F.xxhash64("_id"), F.lit(3)) < 2).alias("grow"), *[F.col(f).cast("double").alias(f) for f in FEATURES])


def _between(values: set[float]) -> list[float]:
    """Thresholds half-way between neighbouring quantiles."""
    ranked = sorted(values)
    return [(a + b) / 2 for a, b in zip(ranked[:-1], ranked[1:], strict=True)] or ranked


def _less_than(feature: str):
    return lambda cut: cut < F.col(feature)


def learn(rows: DataFrame, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.95, bins: int = 32) -> list[list[Condition]]:
    """The decision list: each rule's conditions all hold for documents to reject."""
    rows = stored(rows, "labelled")
    at = [k / bins for k in range(1, bins)]
    asked = [F.percentile_approx(F.when(F.col("bad") == side, F.col(f)), at, 10_000).alias(f"{f}_{side}") for f in FEATURES for side in (True, False)]
    found = rows.agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"), *asked).first()
    if not found or not found["n_bad"] or not found["n_good"]:
        return []
    cuts = {f: _between({float(x) for side in (True, False) for x in found[f"{f}_{side}"] or []}) for f in FEATURES}
    below = [F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), _less_than(f))) for f in FEATURES]
    binned = stored(rows.withColumn("_bins", F.array(*below)), "binned")
    least = max(2, found["n_bad"] // 500)
    learned: list[list[Condition]] = []
    left = F.lit(True)
    for _ in range(most_rules):
        rule: list[Condition] = []
        growing = binned.filter(F.col("grow") & left)
        while len(rule) < most_conditions:
            counts = (
                growing.filter(_all(rule)).select("bad", F.posexplode("_bins").alias("feature", "bin")).groupBy("feature", "bin")
                .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            )
            best = _best(counts, cuts)
            if best is None:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        tests = [x for k in range(len(rule)) for held in [_all(rule[: k + 1])] for x in (F.count_if(held & F.col("bad")).alias(f"p{k}"), F.count_if(held & ~F.col("bad")).alias(f"n{k}"))]
        held = binned.filter(~F.col("grow") & left).agg(*tests).first()
        scores = [((held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]), -k) for k in range(len(rule))]
        k = -max(scores)[1]
        p, n = held[f"p{k}"], held[f"n{k}"]
        if p < least or p < precision * (p + n):
            break
        learned.append(rule[: k + 1])
        left = left & ~_all(rule[: k + 1])
    return learned


def _best(counts: list, cuts: dict[str, list[float]]) -> tuple[float, Condition, int] | None:
    """The condition that gains most, its gain, and the good rows it would still cover."""
    table: dict[int, list] = {}
    for row in counts:
        table.setdefault(row["feature"], []).append((row["bin"], row["p"], row["n"]))
    best = None
    for k, rows in sorted(table.items()):
        feature = FEATURES[k]
        p_all, n_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not p_all or not n_all:
            return best
        prior = log2(p_all / (p_all + n_all))
        for j, cut in enumerate(cuts[feature]):
            # bins up to j lie at or below the cut
            p_low, n_low = sum(r[1] for r in rows if r[0] <= j), sum(r[2] for r in rows if r[0] <= j)
            for above, p, n in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
                if p and (gain := p * (log2(p / (p + n)) - prior)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(feature, above, cut), n)
    return best


def verdict(rules: list[list[Condition]]) -> Column:
    """True for documents to keep: the ordered conditional expression of the list."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, list[list[Condition]]]:
    """Statistics and verdict of every document, and the list learned from the labelled ones."""
    stats = stored(with_statistics(docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])).drop("text"), "statistics")
    rules = learn(labelled(stats, labels))
    return stats.withColumn("kept", verdict(rules)), rules

"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all training rows. A covariance is shrunk towards the pooled diagonal,
its Cholesky factor and that factor's inverse are taken once, and a text's score is the logistic function of the
difference of the classes' log densities (Mahalanobis distances by the cached inverses, log determinants, log priors).

Null or empty text: the statistics of no words, scored like any other. A text of any length is one list of words in
memory. Rows with equal texts have equal scores, and an empty table gives no rows. Columns not named in `keep` are
ignored; features, score, held_out and predicted are columns of the result. Labels that are null or neither 0 nor 1 are
left out; repeated label rows count once, with the lower quality. If a class has no row, every score is the share of
class 1 among the labels, or 0.5 without labels. A null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlake.llm.shared import slices, stored, texts

SYMBOLS = b"#*$%&|<>"
NAMES = ("log_words", "mean_word", "symbols", "shouts", "capitals", "digits", "distinct", "neighbours", "dup_lines", "line_words", "punctuation")


def statistics(text: str) -> list[float]:
    """Transformed statistics of one text; shares are under square roots, so that small ones spread, and drawn to 0 in short texts."""
    raw = text.encode()
    words = raw.split()
    n, chars = len(words), max(1, sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        float(np.log1p(n)),
        float(np.log1p(chars / max(1, n))),
        float(np.sqrt(histogram[list(SYMBOLS)].sum() / (chars + 30))),
        float(np.sqrt(histogram[33] / (chars + 30))),
        float(np.sqrt(histogram[65:91].sum() / (chars + 30))),
        float(np.sqrt(histogram[48:58].sum() / (chars + 30))),
        float(np.log1p(distinct + 5) / np.log1p(n + 5)),
        float(np.sqrt(again / (n + 5))),
        float(np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 3))),
        float(np.log1p(n / (len(lines) + 3))),
        float(np.sqrt(histogram[[44, 46, 59, 63]].sum() / (chars + 30))),
    ]


def with_features(docs: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """The rows without the text but with its statistics."""
    keep = [f for f in docs.schema.fields if f.name not in (text, name)]
    schema = T.StructType([*keep, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                values = pa.array([statistics(x) for x in texts(part, text)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in keep] + [values], names=[f.name for f in schema.fields])

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % folds


class Discriminant:
    """Means, Cholesky factors and log determinants of the two classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = 0.1, ridge: float = 1e-3):
        self.prior = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        self.ready = bool((counts > 0).all())
        if not self.ready:
            return
        size = sums.shape[1]
        pooled = (squares.sum(0) - sum(np.outer(s, s) / n for s, n in zip(sums, counts, strict=True))) / counts.sum()
        target = np.diag(np.maximum(np.diag(pooled), ridge))
        self.means = sums / counts[:, None]
        self.inverses, self.constants = [], []
        for k in (0, 1):
            own = squares[k] / counts[k] - np.outer(self.means[k], self.means[k])
            # few rows of a class: more of the pooled diagonal
            weight = shrink + (1 - shrink) * size / (size + counts[k])
            factor = np.linalg.cholesky((1 - weight) * own + weight * target + ridge * np.eye(size))
            self.inverses.append(np.linalg.inv(factor))
            self.constants.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.ready or not len(x):
            return np.full(len(x), self.prior)
        density = []
        for k in (0, 1):
            z = self.inverses[k] @ (x - self.means[k]).T
            density.append(self.constants[k] - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, folds: int = 5, name: str = "features", **how: float) -> Discriminant:
    """Learn from the labelled rows outside fold 0: one aggregation of sums and products."""
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_class"))
    size = len(NAMES)
    at = [F.col(name)[i] for i in range(size)]
    asked = [F.count(F.lit(1)).alias("n"), *[F.sum(at[i]).alias(f"s{i}") for i in range(size)], *[F.sum(at[i] * at[j]).alias(f"q{i}_{j}") for i in range(size) for j in range(i + 1)]]
    rows = features.filter(fold("doc_id", folds) != 0).join(marks, F.col("doc_id") == F.col("_id")).groupBy("_class").agg(*asked).collect()
    counts, sums, squares = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
    for row in rows:
        k = int(row["_class"])
        counts[k] = row["n"]
        sums[k] = [row[f"s{i}"] for i in range(size)]
        for i in range(size):
            for j in range(i + 1):
                squares[k, i, j] = squares[k, j, i] = row[f"q{i}_{j}"]
    return Discriminant(counts, sums, squares, **how)


def with_scores(features: DataFrame, model: Discriminant, name: str = "features", score: str = "score") -> DataFrame:
    keep = [f for f in features.schema.fields if f.name != score]
    schema = T.StructType([*keep, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(name))
            x = np.asarray(column.flatten(), dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in keep], pa.array(model.scores(x), pa.float64())], names=[f.name for f in schema.fields])

    return features.select(*[f.name for f in keep]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep columns, held_out, score, predicted) of every document."""
    features = stored(with_features(docs.select(*keep, "text")), "features")
    scored = with_scores(features, fit(features, labels, folds))
    return scored.select(*keep, (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

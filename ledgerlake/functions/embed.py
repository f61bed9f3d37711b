"""Feature-hashing embeddings and vector functions."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ledgerlake.functions.text import fingerprint_words, let

ROWS_AT_ONCE = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length; the longer vector's tail counts for its length alone."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def token_slot(token: Column, dims: int) -> Column:
    """The slot (first eight bytes of sha256, modulo dims) and sign (parity of the ninth) of a token."""
    digest = F.sha2(token.cast("binary"), 256)
    head = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    sign = F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return F.struct((head % dims).cast("int").alias("slot"), sign.alias("sign"))


def hashed_embedding(df: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """(key, embedding) of each row: signed token counts by slot as `token_slot` has them, at length 1.

    A row's vector follows from its own text, so nothing is shuffled; Spark cuts the words, and numpy adds them up a batch of
    rows at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                words = part.column(1).flatten().dictionary_encode()
                digests = [sha256(token.encode()).digest() for token in words.dictionary.to_pylist()]
                slots = np.array([int.from_bytes(d[:8]) % dims for d in digests], np.int64)
                signs = np.array([1.0 - 2.0 * (d[8] % 2) for d in digests], float)
                own, row = words.indices.to_numpy(), np.repeat(np.arange(part.num_rows), np.asarray(part.column(1).value_lengths()))
                sums = np.bincount(row * dims + slots[own], signs[own], part.num_rows * dims).reshape(-1, dims)
                length = np.sqrt((sums * sums).sum(1, keepdims=True))
                values = pa.array((sums / np.where(length == 0, 1.0, length) + 0.0).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * dims, pa.int32()), values)], names=[key, "embedding"])

    words = F.coalesce(fingerprint_words(text), F.array().cast("array<string>"))
    return df.select(F.col(key), words.alias("words")).mapInArrow(run, StructType([df.select(key).schema[0], StructField("embedding", ArrayType(DoubleType()))]))


def lexical_score(text: Column, terms: list[str]) -> Column:
    """Occurrences of distinct query terms over the number of words; null for a text without words."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)]) if terms else F.array().cast("array<string>")
    return let(fingerprint_words(text), lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda t: F.array_contains(wanted, t))) / F.size(w)))


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))

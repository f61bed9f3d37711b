"""Vectors as whole numbers: what hard-negative mining and centroid clustering share.

A vector that is null, holds a null or non-finite component, or whose whole components have a squared norm of 2**60 or
more (so that products and distances need not fit a long) has null in place of its numbers. An empty vector has none
to hold, so it stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Squared norms stay below this, so products stay below it and squared distances below four times it.
MOST_NORM = 2.0**60


def packed(vectors: pa.Array, scale: float) -> list[bytes | None]:
    """floor(scale * x) of each component, little-endian in 2 bytes where all of a vector's fit, else in 4."""
    out: list[bytes | None] = [None] * len(vectors)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1), np.int64)
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)  # nulls are nan here
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    with np.errstate(all="ignore"):
        whole = np.floor(values * scale)
        for size in np.unique(lengths[lengths >= 0]).tolist():
            rows = np.flatnonzero(lengths == size)
            own = whole[starts[rows][:, None] + np.arange(size)]
            fits = (own * own).sum(1) < MOST_NORM  # false for nan and inf too
            short = fits & (np.abs(own).max(1, initial=0) < 2**15)
            for kind, some in (("<i2", short), ("<i4", fits & ~short)):
                for k, raw in zip(rows[some].tolist(), own[some].astype(kind), strict=True):
                    out[k] = raw.tobytes()
    return out


def with_whole(rows: DataFrame, vector: str, scale: float) -> DataFrame:
    """The rows with size (int) and q (packed numbers, null for a vector that has none) in place of the vector."""
    schema = T.StructType([*rows.drop(vector).schema.fields, T.StructField("size", T.IntegerType()), T.StructField("q", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                vectors = part.column(part.num_columns - 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pc.list_value_length(vectors).cast(pa.int32()), pa.array(packed(vectors, scale), pa.binary())], names=schema.names)

    return rows.select(*[c for c in rows.columns if c != vector], F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def unpacked(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors of one size as rows of longs."""
    raw = column.to_pylist()
    out = np.zeros((len(raw), size), np.int64)
    if size:
        width = np.fromiter(map(len, raw), np.int64, len(raw)) // size
        for k in np.unique(width).tolist():
            some = np.flatnonzero(width == k)
            out[some] = np.frombuffer(b"".join([raw[i] for i in some.tolist()]), f"<i{k}").reshape(-1, size)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of longs, exact: in doubles where norms prove every partial sum below 2**53, else in longs."""
    most = [np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] < 2**52:
        return a.astype(float) @ b.astype(float).T
    return a @ b.T

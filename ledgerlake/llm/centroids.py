"""Centroid clustering of whole-number vectors, with equal vectors drawn together.

Equal vectors are grouped once, with their number; Lloyd's rounds then run over distinct vectors, and sums are weighted
by that number, so copies cost nothing a round. A task sends one row a centroid and round: its weight and its sums, as
exact whole numbers; the centroids are all that passes through the driver. Assignments are joined back to the rows.

Distances are squared, exact whole numbers; ties go to the smaller centroid, and an empty one stays where it is. Rows
whose vector is null, has another length, holds a null or non-finite component or has no whole numbers (see vectors)
are left out. Rows that repeat an id are rows of their own, and those with the same start key are taken in the order
of their vectors. A row with a null id is clustered but starts no centroid; without any start there is no result. With
fewer vectors than centroids there are as many as vectors. A sum of distances that doesn't fit a long is null. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.shared import stored
from ledgerlake.llm.vectors import products, unpacked, with_whole


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid, the first of several, and its squared distance."""
    distance = (vectors * vectors).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * products(vectors, centroids).astype(np.int64)
    best = distance.argmin(1)
    return best, distance[np.arange(len(best)), best]


def weighted_sums(vectors: np.ndarray, weights: np.ndarray) -> list[int]:
    """Exact sums of the weighted rows, in longs where they are sure to fit."""
    if np.abs(vectors).max(initial=0) * float(weights.sum()) < 2**62:
        return (vectors * weights[:, None]).sum(0).tolist()
    return (vectors.astype(object) * weights.astype(object)[:, None]).sum(0).tolist()


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, n, cluster, distance) of every distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(unpacked(batch.column("q"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, "q binary, n long, cluster int, distance long")


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the mean of what is nearest to each."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), object)
        for batch in batches:
            vectors, weights = unpacked(batch.column("q"), size), np.asarray(batch.column("n"))
            cluster, _ = nearest(vectors, centroids)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                total[c] += np.array([int(weights[own].sum()), *weighted_sums(vectors[own], weights[own])], object)
        full = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(full, size + 1), pa.int32()), pa.array(np.tile(np.arange(size + 1), len(full)), pa.int32()), pa.array([str(x) for x in total[full].ravel()], pa.string()),
        ], names=["cluster", "place", "x"])

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, place int, x string")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out, found = centroids.copy(), {(r.cluster, r.place): int(r.x) for r in sums.collect()}  # a row a centroid and component
    for c in range(k):
        if n := found.get((c, 0), 0):
            out[c] = [found[c, i + 1] // n for i in range(size)]
    return out


def clustered(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id", size: int = 64, scale: float = 1024, clusters: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row with a vector of `size` components.

    Centroids start as the vectors of the `clusters` rows with the smallest sha256 of `seed:id`, in that order.
    """
    plain = rows.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("_vector"))
    whole = stored(with_whole(plain, "_vector", scale).filter((F.col("size") == size) & F.col("q").isNotNull()).select("vec_id", "q"), "whole")
    # counted by tasks before it moves, so a vector that is a third of all rows is a row a task
    distinct = stored(whole.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = whole.filter("vec_id is not null").withColumn("_key", key).orderBy("_key", "q").select("q").limit(clusters).toArrow()
    centroids = unpacked(first.column("q"), size)
    answer = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], answer)
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    last = stored(assigned(distinct, centroids), "assigned")
    each = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("total")).collect()  # a row a centroid
    fits = lambda x: x if x < 2**63 else None
    inertia = sum(int(r.total) for r in each)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = rows.sparkSession.createDataFrame([(r.cluster, fits(int(r.total)), fits(inertia), shas[r.cluster]) for r in each], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = whole.join(last.select(F.col("q").alias("_q"), "cluster", "distance"), F.col("q") == F.col("_q"))
    return back.join(F.broadcast(told), F.col("cluster") == F.col("_cluster")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

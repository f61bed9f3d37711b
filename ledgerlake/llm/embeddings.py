"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are at cosine c or more just if they are within sqrt(2 - 2c). Equal vectors are joined first and count as
one. The rest are sorted by the grid cells, one epsilon wide, of their projections on the leading principal
dimensions; runs of the sorted sequence are joined pair by pair, recursively by halves, and two halves are skipped
when the boxes around their projections are further apart than epsilon, which proves that no pair links (projections
never lengthen distances). Boxes of runs, and of their leaves of LEAF vectors, are tested in all leading dimensions
before any vector moves, and of two runs only the leaves that come near each other meet. What is left is compared
exactly, by a matrix product in double precision.

Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing: n_links 0 and themselves as
component. Vectors of other lengths are never compared with each other. Repeated rows are links of each other; rows that
repeat a vec_id with another vector are rows of their own, and each has its own links. A null vec_id counts as a row
but names no component. An empty table gives no rows; columns besides the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.shared import connected_components, local_components, stored

LEAF = 128


def unit_rows(vectors: list) -> list[np.ndarray | None]:
    """Each vector at length 1 in double precision, or None where it links with nothing."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None
        if v is not None and len(v):
            x = np.array([np.nan if e is None else e for e in v], float)
            top = np.abs(x).max()
            x = None if not np.isfinite(top) or top == 0 else x / top
        out.append(None if x is None else x / np.sqrt((x * x).sum()))
    return out


def prepared(rows: DataFrame, vector: str, ident: str) -> DataFrame:
    """(vec_id, row, digest, size, unit): digest is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                unit = unit_rows(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).hexdigest() for u in unit], pa.string()),
                    pa.array([None if u is None else len(u) for u in unit], pa.int32()),
                    pa.array([None if u is None else u.tobytes() for u in unit], pa.binary()),
                ], names=["vec_id", "digest", "size", "unit"])

    return rows.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, digest string, size int, unit binary")


def principal(units: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """Leading principal directions of each vector length, from sums that are added up before they move (size * size numbers a task and length)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, part in by_size(batch):
                x = np.hstack([matrix(part.column("unit"), size), np.ones((part.num_rows, 1))])
                total[size] = total.get(size, 0) + x.T @ x
        for size, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * own.size, pa.int32()), pa.array(np.arange(own.size)), pa.array(own.ravel())], names=["size", "k", "x"])

    def directions(key: tuple, table: pa.Table) -> pa.Table:
        size = key[0].as_py()
        total = np.zeros((size + 1) ** 2)
        total[np.asarray(table.column("k"), np.int64)] = np.asarray(table.column("x"), float)
        total = total.reshape(size + 1, size + 1)
        n = max(1.0, total[-1, -1])
        mean = total[-1, :-1] / n
        _, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
        return pa.table({"size": pa.array([size], pa.int32()), "axes": pa.array([np.ascontiguousarray(vectors[:, ::-1][:, :leading]).tobytes()], pa.binary())})

    sums = units.select("size", "unit").mapInArrow(moments, "size int, k long, x double").groupBy("size", "k").agg(F.sum("x").alias("x"))
    found = sums.groupBy("size").applyInArrow(directions, "size int, axes binary").collect()  # a row a length
    return {r["size"]: np.frombuffer(r["axes"], float).reshape(r["size"], -1) for r in found}


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows of each vector length."""
    size = np.asarray(batch.column("size"))
    for n in np.unique(size).tolist():
        yield n, batch.take(pa.array(np.flatnonzero(size == n)))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, size)


def gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """Squared distance between two boxes."""
    d = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    return float((d * d).sum())


class Run:
    """A run of the sorted sequence: vectors, copies of each, projections, and boxes around aligned halves."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, units: np.ndarray, axes: np.ndarray):
        self.node, self.copies, self.units = node, copies, units
        self.places = units @ axes
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            own = self.places[a:b]
            self.boxes[a, b] = (own.min(0), own.max(0))
        return self.boxes[a, b]


def join(left: Run, right: Run, cosine: float, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Links of each vector of both runs, the component of each (as a position), and pairs compared."""
    same = left is right
    n, m = len(left.node), len(right.node)
    counts_l, counts_r = np.zeros(n, np.int64), np.zeros(m, np.int64)
    label = np.arange(n if same else n + m)
    shift = 0 if same else n
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    held = compared = 0
    stack = [(0, n, 0, m)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1 or same and b1 <= a0:
            continue
        if gap(*left.box(a0, a1), *right.box(b0, b1)) > far:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am = a0 + ((a1 - a0 + 2 * LEAF - 1) // (2 * LEAF)) * LEAF if a1 - a0 > LEAF else a1
            bm = b0 + ((b1 - b0 + 2 * LEAF - 1) // (2 * LEAF)) * LEAF if b1 - b0 > LEAF else b1
            stack += [(x, y, u, v) for x, y in ((a0, am), (am, a1)) for u, v in ((b0, bm), (bm, b1)) if x < y and u < v]
            continue
        hit = left.units[a0:a1] @ right.units[b0:b1].T >= cosine
        compared += hit.size
        if same:
            hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not hit.any():
            continue
        counts_l[a0:a1] += hit @ right.copies[b0:b1]
        counts_r[b0:b1] += left.copies[a0:a1] @ hit
        i, j = np.nonzero(hit)
        edges.append((i + a0, j + b0 + shift))
        held += len(i)
        if held > 2_000_000:
            label, edges, held = local_components(len(label), np.concatenate([np.arange(len(label)), *[e[0] for e in edges]]), np.concatenate([label, *[e[1] for e in edges]])), [], 0
    if edges:
        label = local_components(len(label), np.concatenate([np.arange(len(label)), *[e[0] for e in edges]]), np.concatenate([label, *[e[1] for e in edges]]))
    return (counts_l + counts_r if same else np.concatenate([counts_l, counts_r])), label, np.concatenate([left.node] if same else [left.node, right.node]), compared


def near_duplicates(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id", cosine: float = 0.95, run_rows: int | None = None, leading: int = 8, run_bytes: int = 8_000_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, for a cosine above 0 and up to 0.99999.

    A run has about `run_bytes` of vectors, or `run_rows` rows where that is given.
    """
    if not 0 < cosine <= 0.99999:
        raise ValueError("cosine must lie above 0 and at 0.99999 at most")
    units = stored(prepared(rows, vector, ident), "units")
    equal = units.filter("digest is not null").groupBy("digest", "size").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    # equal vectors are one node; numbers are given once and written down
    classes = stored(equal.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stored(_near_links(classes, cosine, float(np.sqrt(2 - 2 * cosine)), run_rows, run_bytes, leading), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").select(F.col("root").alias("src"), F.col("node").alias("dst"))
    rooted = (
        classes.select("digest", F.col("size").alias("_size"), "node", "copies", "least").join(links.withColumnRenamed("node", "_l"), F.col("node") == F.col("_l"), "left")
        .join(connected_components(edges).withColumnRenamed("node", "_c"), F.col("node") == F.col("_c"), "left")
        .select(F.col("digest").alias("_digest"), "_size", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("_n"), F.coalesce("component", "node").alias("_root"))
    )
    names = rooted.groupBy(F.col("_root").alias("_r")).agg(F.min("least").alias("_component"))
    named = rooted.join(names, F.col("_root") == F.col("_r"))
    out = units.select("vec_id", "digest", "size").join(named, (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _near_links(classes: DataFrame, cosine: float, epsilon: float, run_rows: int | None, run_bytes: int, leading: int) -> DataFrame:
    """(node, links, root) rows of all runs' joins. The length of vectors is part of every key, so all lengths go through the same jobs."""
    axes = principal(classes, leading)
    far = (epsilon + 1e-9) ** 2
    rows_of = lambda size: run_rows or max(LEAF, run_bytes // (8 * size))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in by_size(batch):
                grid = np.floor((matrix(part.column("unit"), size) @ axes[size]) / epsilon).astype(np.int64)
                # one sortable text a vector: its length, then cells in the order of the dimensions
                order = [f"{size:010d}" + "".join(chr(0x100 + c) for c in row) for row in grid.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(order, pa.string())], names=["node", "copies", "size", "unit", "cell"])

    counts = classes.groupBy("size").count().collect()  # a row a length
    runs = max(1, round(sum(r["count"] / rows_of(r["size"]) for r in counts)))
    placed = classes.select("node", "copies", "size", "unit").mapInArrow(cells, "node long, copies long, size int, unit binary, cell string")
    ranged = placed.repartitionByRange(runs, "cell", "node").sortWithinPartitions("cell", "node").coalesce(runs)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list = []
        count = sent = size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            places = np.zeros((count, leading))  # short vectors have fewer dimensions, and zeros in the rest
            places[:, : axes[size].shape[1]] = matrix(table.column("unit"), size) @ axes[size]
            starts = range(0, count, LEAF)
            boxes = [places[k : k + LEAF] for k in starts]
            nodes, copies, raw = np.asarray(table.column("node")), np.asarray(table.column("copies")), table.column("unit").to_pylist()
            part = lambda make: pa.array([make(slice(k, k + LEAF)) for k in starts], pa.binary())
            return pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 32 | sent] * len(boxes), pa.int64()), pa.array([size] * len(boxes), pa.int32()), pa.array(range(len(boxes)), pa.int32()),
                part(lambda at: nodes[at].tobytes()), part(lambda at: copies[at].tobytes()), part(lambda at: b"".join(raw[at])),
                pa.array([x.min(0).tolist() for x in boxes], pa.list_(pa.float64())), pa.array([x.max(0).tolist() for x in boxes], pa.list_(pa.float64())),
            ], names=["run", "size", "leaf", "nodes", "copies", "units", "low", "high"])

        for batch in batches:
            sizes, at = np.asarray(batch.column("size")), 0
            while at < batch.num_rows:
                if count and (sizes[at] != size or count == rows_of(size)):
                    yield out()
                    held, count, sent = [], 0, sent + 1
                size = int(sizes[at])
                alike = np.flatnonzero(sizes[at:] != size)
                take = min(int(alike[0]) if len(alike) else batch.num_rows - at, rows_of(size) - count)
                held.append(batch.slice(at, take))
                count, at = count + take, at + take
        if count:
            yield out()

    sequence = stored(ranged.mapInArrow(gather, "run long, size int, leaf int, nodes binary, copies binary, units binary, low array<double>, high array<double>"), "runs")
    # a run's box, and the boxes of its leaves; vectors stay behind
    least, most = ([f(F.col(side)[d]) for d in range(leading)] for side, f in (("low", F.min), ("high", F.max)))
    outlines = stored(sequence.groupBy("run", "size").agg(F.array(*least).alias("low"), F.array(*most).alias("high"), F.array_sort(F.collect_list(F.struct("leaf", F.col("low").alias("l"), F.col("high").alias("h")))).alias("leaves")), "outlines")
    # runs whose cells in the first dimensions touch: an equi-join on cells, one side with its neighbours
    dims = min(3, leading)

    def spread(more: int, name: str) -> DataFrame:
        out = outlines.select("run", "size", "low", "high")
        for d in range(dims):
            cell = lambda x: F.floor(F.col(x)[d] / epsilon)  # noqa: B023, E731
            out = out.withColumn(f"c{d}", F.explode(F.sequence(cell("low") - more, cell("high") + more)))
        return out.drop("low", "high").withColumnRenamed("run", name)

    at = [f"c{d}" for d in range(dims)]
    touching = spread(0, "a").join(spread(1, "b"), ["size", *at]).filter("a <= b").select("a", "b").distinct()
    sides = [outlines.select(*[F.col(c).alias(f"{c}_{x}") for c in outlines.columns]) for x in "ab"]
    both = touching.join(sides[0], F.col("a") == F.col("run_a")).join(sides[1], F.col("b") == F.col("run_b"))
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col("low_b")[d] - F.col("high_a")[d], F.col("low_a")[d] - F.col("high_b")[d]), F.lit(2.0)) for d in range(leading)), F.lit(0.0))
    near = both.filter((apart <= far) | (F.col("a") == F.col("b"))).select("a", "b", "leaves_a", "leaves_b")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pair of runs the leaves that any leaf of the other comes near."""
        for batch in batches:
            for row in batch.to_pylist():
                boxes = [[np.array([x[side] for x in row[f"leaves_{r}"]]) for side in "lh"] for r in "ab"]
                (low_a, high_a), (low_b, high_b) = boxes
                gaps = np.maximum(0, np.maximum(low_b[None] - high_a[:, None], low_a[:, None] - high_b[None]))
                hit = (gaps * gaps).sum(2) <= far
                found = [(r, int(x["leaf"])) for r, leaves, some in ((row["a"], row["leaves_a"], hit.any(1)), (row["b"], row["leaves_b"], hit.any(0))) for x, yes in zip(leaves, some, strict=True) if yes]
                found = sorted(set(found))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([row["a"]] * len(found), pa.int64()), pa.array([row["b"]] * len(found), pa.int64()), pa.array([r for r, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int32())], names=["a", "b", "_run", "_leaf"])

    wanted = near.mapInArrow(needed, "a long, b long, _run long, _leaf int")
    carried = wanted.join(sequence.select("run", "size", "leaf", "nodes", "copies", "units"), (F.col("run") == F.col("_run")) & (F.col("leaf") == F.col("_leaf"))).drop("_run", "_leaf")

    def compare(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("run", "ascending"), ("leaf", "ascending")])
        a, b, size = (table.column(c)[0].as_py() for c in ("a", "b", "size"))
        loaded = {}
        for run in {a, b}:
            own = rows.filter(pc.equal(rows.column("run"), run))
            raw = {c: b"".join(own.column(c).to_pylist()) for c in ("nodes", "copies", "units")}
            loaded[run] = Run(np.frombuffer(raw["nodes"], np.int64), np.frombuffer(raw["copies"], np.int64), np.frombuffer(raw["units"], float).reshape(-1, size), axes[size])
        counts, label, node, _ = join(loaded[a], loaded[b], cosine, far)
        # the root is the smallest node of its component here
        smallest = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, node)
        some = np.flatnonzero(counts)
        return pa.table({"node": node[some], "links": counts[some], "root": smallest[label[some]]})

    return carried.groupBy("a", "b").applyInArrow(compare, "node long, links long, root long")

"""Clustering of whole-number vectors around centroids, exact in every round."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one matrix product takes at a time.
BLOCK = 8192
LONG = 1 << 63


def usable(vector: Column, dims: int) -> Column:
    """Whether an array has exactly ``dims`` components, none null, NaN or infinite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~odd, F.lit(False))


def tame_limit(dims: int) -> int:
    """Components up to this size keep |x|^2, 2x.c and |c|^2, and every partial sum of them, under
    2**53, so that floating point holds each of these whole numbers exactly."""
    return int((2.0**53 / dims) ** 0.5 / 2)


class Centroids:
    """Whole-number centroids and the search for the nearest one.

    Rows and centroids with components within :func:`tame_limit` are compared by the expansion
    |x|^2 - 2x.c + |c|^2 in float64 matrix products; whatever is beyond, in Python's integers.
    """

    def __init__(self, rows: list[list[int]], dims: int):
        self.rows, self.dims, self.limit = rows, dims, tame_limit(dims)
        tame = [max(map(abs, r), default=0) <= self.limit for r in rows]
        self.tame = np.flatnonzero(tame)
        self.wild = [j for j, t in enumerate(tame) if not t]
        self.c = np.array([rows[j] for j in self.tame], dtype=np.float64).reshape(len(self.tame), dims)
        self.cc = (self.c * self.c).sum(axis=1)

    def is_tame(self, x: np.ndarray) -> np.ndarray:
        return np.abs(x).max(axis=1, initial=0) <= self.limit

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """For each row of ``x`` (whole numbers as float64) the number of the nearest centroid, the
        smaller one at equal distance, and the squared distance as a Python integer."""
        tame = self.is_tame(x) if len(self.tame) else np.zeros(len(x), dtype=bool)
        label, far = np.zeros(len(x), dtype=np.int64), [0] * len(x)
        at = np.flatnonzero(tame)
        if len(at):
            y = x[at]
            d = (y * y).sum(axis=1)[:, None] - 2 * (y @ self.c.T) + self.cc
            best = d.argmin(axis=1)
            label[at] = self.tame[best]
            for i, v in zip(at.tolist(), d[np.arange(len(at)), best].astype(np.int64).tolist(), strict=True):
                far[i] = v
        for i in range(len(x)) if self.wild else np.flatnonzero(~tame).tolist():
            v = [int(a) for a in x[i].tolist()]
            found = [(far[i], int(label[i]))] if tame[i] else []
            found += [(sum((a - b) ** 2 for a, b in zip(v, self.rows[j], strict=True)), j) for j in (self.wild if tame[i] else range(len(self.rows)))]
            far[i], label[i] = min(found)
        return label, far

    def sums(self, x: np.ndarray, label: np.ndarray, totals: list[list[int]], counts: list[int]) -> None:
        """Add the rows to the totals of their centroids, exactly."""
        tame = self.is_tame(x)
        y, mine = x[tame], label[tame]
        one = (mine[None, :] == np.arange(len(self.rows))[:, None]).astype(np.float64)
        for j, row in enumerate((one @ y).astype(np.int64).tolist()):
            totals[j] = [a + b for a, b in zip(totals[j], row, strict=True)]
        for i in np.flatnonzero(~tame).tolist():
            j = int(label[i])
            totals[j] = [a + int(b) for a, b in zip(totals[j], x[i].tolist(), strict=True)]
        for j, n in enumerate(np.bincount(label, minlength=len(self.rows)).tolist()):
            counts[j] += n


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, floor(scale * x)) of up to BLOCK rows at a time."""
    for batch in batches:
        flat = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dims)
        for k in range(0, len(flat), BLOCK):
            yield batch.column(0).slice(k, BLOCK), np.floor(flat[k : k + BLOCK] * scale)


def _merged(a: list | None, b: list | None) -> list | None:
    """The sum of two lists of (count, inertia, totals), one entry a centroid."""
    if a is None or b is None:
        return a if b is None else b
    return [(n + m, d + e, [x + y for x, y in zip(s, t, strict=True)]) for (n, d, s), (m, e, t) in zip(a, b, strict=True)]


def _assigned(kept: DataFrame, centroids: Centroids, scale: float) -> list:
    """(count, inertia, totals) of each centroid over all rows.  A task sends one row, and a tree
    of additions brings these together, so the driver gets few of them however many tasks run."""
    dims, k = centroids.dims, len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts, inertia = [[0] * dims for _ in range(k)], [0] * k, [0] * k
        for _, x in _blocks(batches, dims, scale):
            label, far = centroids.nearest(x)
            centroids.sums(x, label, totals, counts)
            for j, d in zip(label.tolist(), far, strict=True):
                inertia[j] += d
        if any(counts):
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(list(zip(counts, inertia, totals, strict=True)))], pa.binary())})

    parts = kept.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeAggregate(None, _merged, _merged, depth=2) or [(0, 0, [0] * dims)] * k


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster int, distance, cluster_inertia, inertia long, centroid_sha256) of each kept row.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; each component x
    becomes floor(``scale`` * x).  Centroids start as the ``k`` kept vectors whose id, as decimal
    text after ``seed``, has the smallest sha256 (fewer if there are fewer).  Each round assigns
    every vector to the nearest centroid (ties: the smaller number) and replaces each centroid that
    has vectors by floor(sum / count); then vectors are assigned once more.  All of it is exact.

    Only centroids and their sums (``k`` by ``dims`` whole numbers) come to the driver.  Rows with a
    null id are assigned and summed like others but start no centroid; rows that repeat an id are
    vectors of their own, and of two with one hash the smaller vector comes first.  Other columns
    are not returned.  No kept row gives no rows.  ``scale`` * x must be finite as a double.  A
    distance or inertia that 64 bits can't hold is null.
    """
    kept = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("e"))
    kept = kept.where(usable(F.col("e"), dims))
    hashed = kept.select(F.sha2(F.concat(F.lit(seed), F.col("i").cast("string")).cast("binary"), 256).alias("h"), "e").where("h IS NOT NULL")
    start = [[int(np.floor(x * scale)) for x in r["e"]] for r in hashed.orderBy("h", "e").limit(k).collect()]
    kind = vectors.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not start:
        return vectors.sparkSession.createDataFrame([], shape)
    centroids = Centroids(start, dims)
    for _ in range(rounds):
        found = _assigned(kept, centroids, scale)
        centroids = Centroids([[t // n for t in total] if n else old for (n, _, total), old in zip(found, centroids.rows, strict=True)], dims)
    inertia = [d for _, d, _ in _assigned(kept, centroids, scale)]
    fits = lambda v: v if v < LONG else None
    facts = pa.table({
        "cluster_inertia": pa.array([fits(d) for d in inertia], pa.int64()), "inertia": pa.array([fits(sum(inertia))] * len(inertia), pa.int64()),
        "centroid_sha256": pa.array([hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in centroids.rows], pa.string()),
    })

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dims, scale):
            label, far = centroids.nearest(x)
            mine = facts.take(pa.array(label))
            columns = [ids, pa.array(label, pa.int32()), pa.array([fits(d) for d in far], pa.int64()), *[c.combine_chunks() for c in mine.columns]]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", *facts.column_names])

    return kept.mapInArrow(assign, shape)

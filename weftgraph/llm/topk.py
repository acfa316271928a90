"""Exact top-k inner products with norm order, an SVD rotation and Cauchy-Schwarz bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import written

#: A pass broadcasts at most about so many queries; a candidate block has so many rows.
QUERIES, BLOCK = 4_096, 1_024
#: So many of the longest candidates give each query its first k-th score to beat.
HEAD = 2_048


def whole(vectors: list, scale: int) -> list[bytes | None]:
    """floor(scale * x) of each component as int64 bytes; None where a vector is null or holds
    null or non-finite components.  A component that has no int64 is an error that shows it."""
    out = []
    for v in vectors:
        if v is None or any(c is None for c in v):
            out.append(None)
            continue
        x = np.asarray(v, dtype=np.float64)
        if not np.isfinite(x).all():
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            x = np.floor(scale * x)
        if (np.abs(x) >= 2.0**63).any():
            raise OverflowError(f"{scale} * {v!r:.200} has a component beyond 64 bits")
        out.append(x.astype("<i8").tobytes())
    return out


def rotation(gram: np.ndarray) -> np.ndarray:
    """Right singular vectors of the candidates, from their Gram matrix, the strongest first."""
    return np.linalg.eigh(gram)[1][:, ::-1]


def products(x: np.ndarray, q: np.ndarray, bound: float) -> list[int]:
    """Exact inner products of the rows of ``x`` with ``q``; ``bound`` is above the product of their
    lengths.  Where 64 bits might not do, whole numbers of any size are used."""
    if bound < 2.0**62:
        return (x @ q).tolist()
    return (x.astype(object) @ q.astype(object)).tolist()


class Searcher:
    """Top ``k`` of a set of queries over blocks of candidates, best by descending length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.rows, self.q, self.v, self.k = ids, rows, q, v, k
        self.lead = max(1, min(q.shape[1], 16))
        turned = q.astype(np.float64) @ v
        self.turned = turned[:, : self.lead]
        self.rest = np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.bar = floor.astype(np.float64)  # the k-th score so far; what is below it is out
        self.heaps: list[list] = [[] for _ in ids]

    def block(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        """Take in one block; its own greatest length rules out queries that can't gain from it."""
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        slack = 1e-6 * (1 + self.length * length.max(initial=0))  # rounding of the bounds
        alive = np.flatnonzero(self.length * length.max(initial=0) + slack >= self.bar)
        if not len(alive):
            return
        turned = x.astype(np.float64) @ self.v
        lead, rest = turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))
        bound = self.turned[alive] @ lead.T + self.rest[alive, None] * rest + slack[alive, None]
        for a, q in enumerate(alive):
            at = np.flatnonzero(bound[a] >= self.bar[q])
            at = at[rows[at] != self.rows[q]]
            if not len(at):
                continue
            heap = self.heaps[q]
            for s, i in zip(products(x[at], self.q[q], 1.01 * self.length[q] * length[at].max()), ids[at].tolist(), strict=True):
                item = (s, -i)
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.bar[q] = max(self.bar[q], heap[0][0])


def unpack(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype="<i8").reshape(len(units), -1)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score: for each row whose id is divisible by ``every``
    the ``k`` rows of highest integer inner product, itself left out, ties to the smaller id.

    Components become floor(scale * x).  Vectors that are null or hold null or non-finite
    components take no part, nor do rows with a null id; a vector of another width than the most
    common one neither.  Scores are exact; a component, or a score among a query's ``k``, that 64 bits can't
    hold is an error, never a wrapped or a missing number.  Of rows that repeat an id each is a candidate and a query of its own.
    Fewer than ``k`` candidates give as many rows; an empty table gives none.

    Candidates are written once, by descending length, and read by each pass over the queries,
    which are broadcast in batches of bounded size, so nothing but k rows a query and task is
    shuffled.  Within a task the first singular directions bound a score from above; only what
    the bound lets through is multiplied out, and a block is passed over where lengths alone rule
    it out.
    """
    spark = vectors.sparkSession

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = whole(batch.column(2).to_pylist(), scale)
            length = [None if u is None else float((np.frombuffer(u, "<i8").astype(float) ** 2).sum()) for u in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(got, pa.binary()), pa.array(length, pa.float64())], names=["row", "id", "unit", "length"])

    turned = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(vector_col)).mapInArrow(turn, "row bigint, id bigint, unit binary, length double")
    able = written(turned.where("id IS NOT NULL AND unit IS NOT NULL"), "able")
    widths = able.groupBy(F.octet_length("unit").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 0
    able = able.where(F.octet_length("unit") == width)
    n = widths[0]["count"] if widths else 0
    parts = max(1, math.ceil(n / 50_000))
    ordered = written(able.repartitionByRange(parts, F.desc("length"), F.col("row")).sortWithinPartitions(F.desc("length"), "row"), "ordered")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column(0).to_pylist()).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    empty = "query_id bigint, rank int, id bigint, score bigint"
    if not n or not width:
        return spark.createDataFrame([], empty).withColumnRenamed("id", id_col)
    d = width // 8
    # one d x d matrix a task, added up by component, so the driver gets a single one
    grams = ordered.select("unit").mapInArrow(gram, "g binary")
    total = sum((np.frombuffer(r["g"]).reshape(d, d) for r in grams.toLocalIterator()), np.zeros((d, d)))
    v = rotation(total)
    head = ordered.orderBy(F.desc("length"), "row").limit(HEAD).select("row", "id", "unit").toArrow()
    head_rows, head_ids, head_x = head.column(0).to_numpy(), head.column(1).to_numpy(), unpack(head.column(2).to_pylist())

    asked = ordered.where(F.col("id") % every == 0)
    passes = max(1, math.ceil(asked.count() / QUERIES))
    results = None
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).select("row", "id", "unit").toArrow()
        if not mine.num_rows:
            continue
        q_rows, q_ids, q = mine.column(0).to_numpy(), mine.column(1).to_numpy(), unpack(mine.column(2).to_pylist())
        first = Searcher(q_ids, q_rows, q, v, k, np.full(len(q), -np.inf))
        for a in range(0, len(head_x), BLOCK):
            first.block(head_ids[a : a + BLOCK], head_rows[a : a + BLOCK], head_x[a : a + BLOCK])
        sent = spark.sparkContext.broadcast((q_ids, q_rows, q, first.bar, v))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q_rows, q, bar, v = sent.value
            finder = Searcher(q_ids, q_rows, q, v, k, bar)
            for batch in batches:
                for a in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(a, BLOCK)
                    # later rows may be longer: a task, and so a batch, can hold the files of several ranges
                    finder.block(part.column(1).to_numpy(), part.column(0).to_numpy(), unpack(part.column(2).to_pylist()))
            got = [(int(q_rows[i]), int(q_ids[i]), -neg, s) for i, heap in enumerate(finder.heaps) for s, neg in heap]
            # a score beyond 64 bits keeps its place at one end of the order: if it is too high, so
            # is any that beats it; if too low, only others like it don't
            beyond = pa.array([not -(2**63) <= g[3] < 2**63 for g in got], pa.bool_())
            score = pa.array([max(-(2**63), min(2**63 - 1, g[3])) for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([g[j] for g in got], pa.int64()) for j in range(3)], score, beyond], names=["q_row", "query_id", "id", "score", "beyond"])

        found = ordered.select("row", "id", "unit").mapInArrow(search, "q_row bigint, query_id bigint, id bigint, score bigint, beyond boolean")
        results = found if results is None else results.unionAll(found)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "id"))
    top = results.withColumn("rank", rank).where(F.col("rank") <= k)
    score = F.when(F.col("beyond"), F.raise_error(F.concat(F.lit("a score is beyond 64 bits, at the query "), F.col("query_id").cast("string"))).cast("bigint")).otherwise(F.col("score"))
    return top.select("query_id", "rank", F.col("id").alias(id_col), score.alias("score"))

"""Matrix factorisation by stochastic gradient descent over a bipartite graph of ratings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vectors import clamp, dot
from weftgraph.plans.lineage import written
from weftgraph.plans.loops import iterate


def _descend(rate: float, ridge: float, low: float, high: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows (dst, src, vec, rating) in order of dst, then src: a vertex's own vector comes
    first, with a null src; every other row is what it hears, and moves that vector by one step.
    Only the vector of the vertex at hand is kept, from one batch to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vec, heard = None, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = [], []
            size = len(batch.column(2)[0])
            flat = batch.column(2).flatten().to_pylist()
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), range(0, len(flat), size), strict=True)
            for dst, src, rating, i in rows:
                told = flat[i : i + size]
                if src is None:
                    if heard:
                        ids.append(at)
                        vecs.append(vec)
                    at, vec, heard = dst, told, False
                    continue
                heard = True
                product = 0.0
                for x, y in zip(vec, told, strict=True):
                    product += x * y
                err = min(max(product, low), high) - rating
                vec = [x + (x * ridge + y * err) * -rate for x, y in zip(vec, told, strict=True)]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float64()))], names=["id", "vec"])
        if heard:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([vec], pa.list_(pa.float64()))], names=["id", "vec"])

    return run


def factorise(ratings: DataFrame, size: int = 2, updates: int = 4, rate: float = 0.005, ridge: float = 0.01, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(id, vec) after ``updates`` supersteps from vectors of ones.

    ``ratings``: user, item, rating, with ids of users and items apart.  In a superstep every
    vertex hears the vectors of those it shares a rating with and takes a gradient step for each,
    in order of their ids, so the result does not depend on partitioning.  What a vertex hears is
    sorted by Spark and streamed past its vector: an item with a million ratings takes a task some
    time, but no memory.
    """
    both = ratings.select(F.col("user").alias("src"), F.col("item").alias("dst"), F.col("rating").cast("double").alias("rating"))
    both = written(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rating")), "ratings")
    ones = F.array(*[F.lit(1.0)] * size)
    descend = _descend(rate, ridge, low, high)

    def step(state: DataFrame, _: int) -> DataFrame:
        own = state.select(F.col("id").alias("dst"), F.lit(None).cast("bigint").alias("src"), "vec", F.lit(None).cast("double").alias("rating"))
        heard = both.join(state, F.col("src") == F.col("id")).select(F.col("dst").cast("bigint"), F.col("src").cast("bigint"), "vec", "rating")
        rows = own.unionByName(heard).repartition("dst").sortWithinPartitions("dst", F.col("src").asc_nulls_first(), "rating")
        return rows.mapInArrow(descend, "id bigint, vec array<double>")

    return iterate(both.select(F.col("src").cast("bigint").alias("id")).distinct().withColumn("vec", ones), step, updates, every=1)


def rmse(ratings: DataFrame, vectors: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """One row: ratings, rmse of the clamped products."""
    u = vectors.select(F.col("id").alias("user"), F.col("vec").alias("u"))
    i = vectors.select(F.col("id").alias("item"), F.col("vec").alias("i"))
    err = clamp(dot(F.col("u"), F.col("i")), low, high) - F.col("rating")
    return ratings.join(u, "user").join(i, "item").agg(F.count("*").alias("ratings"), F.sqrt(F.avg(err * err)).alias("rmse"))

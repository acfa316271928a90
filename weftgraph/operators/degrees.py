"""Degrees of neighbours, as a transform in three phases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.phases import Partition, Phase, in_phases

#: A node's own degree (first 0, in ``degree``), or an edge of it (first 1, to ``other``).
ROWS = "node bigint, kind int, other bigint, degree bigint"


def _rows(node: pa.Array, kind: int, other: pa.Array | None, degree: pa.Array | None) -> pa.RecordBatch:
    n = len(node)
    empty = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([node, pa.array(np.full(n, kind, np.int32)), empty if other is None else other, empty if degree is None else degree], names=["node", "kind", "other", "degree"])


def _counted(part: Partition) -> Iterator[pa.RecordBatch]:
    """A node's edges as they pass by, then how many there were."""
    n = 0
    for rows in part:
        n += rows.num_rows
        yield _rows(rows.column(0), 1, rows.column(1), None)
    yield _rows(pa.array([part.key[0]], pa.int64()), 0, None, pa.array([n], pa.int64()))


def _told(part: Partition) -> Iterator[pa.RecordBatch]:
    """A node's degree, to itself and along each of its edges."""
    degree = None
    for rows in part:
        if degree is None:
            degree = rows.column(3)[0].as_py()
            yield _rows(rows.column(0).slice(0, 1), 0, None, rows.column(3).slice(0, 1))
            rows = rows.slice(1)
        if rows.num_rows:
            yield _rows(rows.column(2), 1, None, pa.array(np.full(rows.num_rows, degree, np.int64)))


def _met(part: Partition) -> Iterator[pa.RecordBatch]:
    """How often each degree is among those who told a node, with the node's own as what they met."""
    own = None
    for rows in part:
        if own is None and rows.column(1)[0].as_py() == 0:
            own = rows.column(3)[0].as_py()
            rows = rows.slice(1)
        if own is not None and rows.num_rows:
            degree, n = np.unique(np.asarray(rows.column(3)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(degree), pa.array(np.full(len(n), own, np.int64)), pa.array(n)], names=["degree", "neighbour_degree", "pairs"])


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    """(degree, neighbour_degree, pairs): how many edges go from a node of one out-degree to a node of
    another; nodes without out-edges are left out.

    Three phases of one shuffle each: a node counts its edges, tells its degree along them, and
    tallies what it is told.  A node's edges are streamed in each, so a hub needs no more memory
    than any other node.  What a task tallies is added up before it is shuffled.
    """
    phases = [
        Phase(_counted, ROWS, ("from_node",)),
        Phase(_told, ROWS, ("node",), ("kind",)),
        Phase(_met, "degree bigint, neighbour_degree bigint, pairs bigint", ("node",), ("kind",)),
    ]
    met = in_phases(edges.select(F.col("from_node").cast("bigint"), F.col("to_node").cast("bigint")).where("from_node IS NOT NULL AND to_node IS NOT NULL"), phases)
    return met.groupBy("degree", "neighbour_degree").agg(F.sum("pairs").alias("pairs"))

"""Transforms in several phases over partitioned and ordered rows, and functions over ordered rows
that know where a partition and a group of peers begin."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def begins(columns: Sequence[pa.Array], last: list | None) -> np.ndarray:
    """Where a row of ``columns`` differs from the row before it; ``last`` are the values before the
    first (None: there are none, and the first begins).  Nulls are alike, and so are NaNs."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    for k, c in enumerate(columns):
        if n > 1:
            a, b = c.slice(0, n - 1), c.slice(1)
            same = pc.fill_null(pc.equal(a, b), False)
            same = pc.or_(same, pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
            if pa.types.is_floating(c.type):  # a null is no NaN
                same = pc.and_(same, pc.equal(pc.is_null(a), pc.is_null(b)))
            out[1:] |= ~np.asarray(same)
        if last is not None:
            x, y = last[k], c[0].as_py()
            out[0] |= not (x == y or (x is None and y is None) or (x != x and y != y and x is not None and y is not None))
    if last is None:
        out[0] = True
    return out


class Partition:
    """One partition of a phase's input, as pieces of record batches in order.

    Iterating reads on; a partition may be larger than memory.  What a function leaves unread is
    passed over.
    """

    def __init__(self, key: tuple, pieces: Iterator[pa.RecordBatch]):
        self.key, self._pieces = key, pieces

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        return self._pieces


def _segments(batches: Batches, keys: Sequence[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The batches cut where a partition begins, each piece with whether one begins with it.  Borders
    of a batch are found once, however many partitions it holds."""
    last: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        starts = np.flatnonzero(begins(columns, last)).tolist() if keys else [0] * (last is None)
        last = [c[-1].as_py() for c in columns]
        begun = [True] * len(starts)
        if not starts or starts[0]:
            starts, begun = [0, *starts], [False, *begun]
        for a, b, new in zip(starts, [*starts[1:], batch.num_rows], begun, strict=True):
            yield new, batch.slice(a, b - a)


def partitions_of(batches: Batches, keys: Sequence[str]) -> Iterator[Partition]:
    """The partitions of rows that come sorted by ``keys``, one after another."""
    segments = _segments(batches, keys)
    at = next(segments, None)

    def pieces() -> Iterator[pa.RecordBatch]:
        """Pieces of the partition that begins now; what comes after it is left in ``at``."""
        nonlocal at
        while at is not None:
            yield at[1]
            at = next(segments, None)
            if at is not None and at[0]:
                return

    while at is not None:
        head = at[1]
        key = tuple(head.column(head.schema.get_field_index(k))[0].as_py() for k in keys)
        body = pieces()
        yield Partition(key, body)
        for _ in body:
            pass


#: Rows that go back to Spark at a time, where partitions give few rows each.
GATHERED = 4096


def gathered(batches: Batches) -> Batches:
    """The same rows in fewer batches, as each one costs Spark more than a row does."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass(frozen=True)
class Phase:
    """One phase: what it does with each partition, the rows that it gives, and how its input is
    dealt.  Without ``partition_by`` it is a prepass: it runs where its input lies, each task's rows
    being one partition, and nothing is shuffled for it."""

    process: Callable[[Partition], Batches]
    schema: str
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()


def in_phases(df: DataFrame, phases: Sequence[Phase]) -> DataFrame:
    """``df`` through ``phases`` in turn, the rows of one being the input of the next.

    A phase with ``partition_by`` costs one shuffle on these columns, unless its input already lies
    so, and a sort by them and by ``order_by``; a prepass costs neither.  Rows are streamed: a
    phase holds what its function holds.  A phase whose columns don't exist is refused before
    anything runs.
    """
    if not phases:
        raise ValueError("there are no phases")
    for k, phase in enumerate(phases, 1):
        missing = [c.removesuffix(" DESC") for c in (*phase.partition_by, *phase.order_by) if c.removesuffix(" DESC") not in df.columns]
        if missing:
            raise ValueError(f"phase {k} is partitioned or ordered by {', '.join(missing)}, which its input ({', '.join(df.columns)}) does not have")
        if phase.order_by and not phase.partition_by:
            raise ValueError(f"phase {k} is a prepass: it takes its rows as they lie, in no order")
        if phase.partition_by:
            order = [F.col(c.removesuffix(" DESC")).desc() if c.endswith(" DESC") else F.col(c) for c in phase.order_by]
            df = df.repartition(*phase.partition_by).sortWithinPartitions(*phase.partition_by, *order)

        def run(batches: Batches, phase: Phase = phase) -> Batches:
            yield from gathered(batch for part in partitions_of(batches, phase.partition_by) for batch in phase.process(part))

        df = df.mapInArrow(run, phase.schema)
    return df


class Analytic:
    """A function over the rows of each partition in order.

    ``reset`` begins a partition.  ``process`` gets a piece of its rows and, for each row, whether a
    group of peers (rows alike in the order) begins with it, and gives one value a row.  What it
    keeps in ``self`` goes on to the next piece.  An instance lives in one task.
    """

    def reset(self) -> None:
        raise NotImplementedError

    def process(self, rows: pa.RecordBatch, new_peers: np.ndarray) -> pa.Array:
        raise NotImplementedError


def with_analytic(df: DataFrame, name: str, kind: str, make: Callable[[], Analytic], partition_by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``df`` with a column ``name`` of type ``kind`` from an analytic function of each partition's
    rows in order (``x DESC`` for descending); one shuffle and one sort, in constant memory."""
    if not partition_by:
        raise ValueError("an analytic function needs columns to partition by, or all rows go to one task")
    keys, peers = list(partition_by), [c.removesuffix(" DESC") for c in order_by]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` {kind}"

    def process(part: Partition) -> Batches:
        function = make()
        function.reset()
        last = None
        for rows in part:
            columns = [rows.column(rows.schema.get_field_index(c)) for c in peers]
            new = begins(columns, last) if columns else np.arange(rows.num_rows) == (0 if last is None else -1)
            last = [c[-1].as_py() for c in columns]
            yield pa.RecordBatch.from_arrays([*rows.columns, function.process(rows, new)], names=[*rows.schema.names, name])

    return in_phases(df, [Phase(process, schema, tuple(keys), tuple(order_by))])


class RunningFold(Analytic):
    """A fold over the rows so far, given after each row: ``fold`` is an associative numpy ufunc of
    whole numbers, such as ``numpy.gcd``; nulls count as nothing, and the value is null before
    the first other."""

    def __init__(self, column: str, fold: np.ufunc):
        self.column, self.fold, self.so_far = column, fold, None

    def reset(self) -> None:
        self.so_far = None

    def process(self, rows: pa.RecordBatch, new_peers: np.ndarray) -> pa.Array:
        values = rows.column(rows.schema.get_field_index(self.column)).cast(pa.int64())
        at = np.flatnonzero(np.asarray(values.is_valid()))
        given = np.asarray(values.drop_null())
        if self.so_far is not None:
            given, at = np.concatenate([[self.so_far], given]), np.concatenate([[-1], at])
        if not len(given):
            return pa.nulls(rows.num_rows, pa.int64())
        folded = self.fold.accumulate(given)
        self.so_far = folded[-1]
        place = np.searchsorted(at, np.arange(rows.num_rows), side="right") - 1
        return pa.array(folded[np.maximum(place, 0)], pa.int64(), mask=place < 0)


class Rank(Analytic):
    """The place of a row's peers: 1 and one more for each row before them; ``dense``: for each group
    of peers before them."""

    def __init__(self, dense: bool = False):
        self.dense = dense

    def reset(self) -> None:
        self.rows, self.groups, self.at = 0, 0, 0

    def process(self, rows: pa.RecordBatch, new_peers: np.ndarray) -> pa.Array:
        if self.dense:
            place = self.groups + np.cumsum(new_peers)
            self.groups = int(place[-1])
        else:
            begun = np.where(new_peers, self.rows + 1 + np.arange(len(new_peers)), 0)
            place = np.maximum.accumulate(np.concatenate([[self.at], begun]))[1:]
            self.at = int(place[-1])
        self.rows += rows.num_rows
        return pa.array(place, pa.int64())


def running_by_peers(df: DataFrame, name: str, column: str, fold: np.ufunc, combine: Callable, partition_by: Sequence[str], order_by: str) -> DataFrame:
    """``df`` with ``name``: the fold of ``column`` over the rows up to and with all of a row's peers, so
    that peers get the same value.

    Peers are folded first, in their tasks and then together, so a group of peers of any size is
    one row when the order is gone through.  ``combine`` is that aggregate as a function of
    (DataFrame, keys, column, name), as :func:`weftgraph.functions.aggregates.exact_gcd` is.
    """
    keys = list(partition_by)
    folded = combine(df, [*keys, order_by], column, "_peers").select(*keys, order_by, F.col("_peers").cast("bigint").alias("_peers"))
    # peers without any value are rows of the order as well
    groups = df.select(*keys, order_by).distinct()
    met = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*keys, order_by)]
    every = groups.alias("g").join(folded.alias("f"), met, "left").select(*[F.col(f"g.{c}").alias(c) for c in (*keys, order_by)], F.col("f._peers").alias("_peers"))
    run = with_analytic(every, name, "bigint", lambda: RunningFold("_peers", fold), keys, [order_by]).drop("_peers")
    back = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, order_by)]
    return df.alias("d").join(run.alias("r"), back).select("d.*", f"r.{name}")

"""Vertex programs as SQL table functions over wire rows.

Each function takes a TABLE argument, to be partitioned and ordered by the caller, and named
parameters; :func:`register` makes them callable by name.  A function reads its partition once, in
order, and keeps the counts of one node (or one block of neighbours) at a time, so neither a
partition nor a node's neighbourhood need fit in memory, and the result does not depend on how many
partitions there are.  A superstep is one call: what a node sends is a relation of its own, and SQL
adds it up and hands it to the next call.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, IntegerType, IntegralType, LongType, ShortType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from weftgraph.functions import list_functions
from weftgraph.plans.lineage import written

#: Neighbours that a call of ``pregel_send`` holds at a time.
BLOCK = 10_000


def _wire(rows: AnalyzeArgument, columns: tuple[str, ...] = ("id", "edge", "value")) -> None:
    """Check that the argument is a table with the columns that the function reads."""
    if not rows.isTable:
        raise ValueError("the first argument must be a table: TABLE(...) PARTITION BY ... ORDER BY ...")
    types = {f.name.lower(): f.dataType for f in rows.dataType.fields}
    missing = [c for c in columns if c not in types]
    if missing:
        raise ValueError(f"the table needs {', '.join(columns)}; there is no {', '.join(missing)}")
    for c in ("id", "edge"):
        if c in columns and not isinstance(types[c], IntegralType):
            raise ValueError(f"{c} must be a whole number and is {types[c].simpleString()}")


def _whole(name: str, value: AnalyzeArgument, least: int) -> None:
    if not isinstance(value.dataType, (ByteType, ShortType, IntegerType, LongType)) or not value.isConstantExpression or value.value is None:
        raise ValueError(f"{name} must be a constant whole number")
    if value.value < least:
        raise ValueError(f"{name} must be at least {least} and is {value.value}")


class _InOrder:
    """Raises where a partition's rows do not come in the order that a function needs."""

    def __init__(self, what: str):
        self.what, self.last = what, None

    def __call__(self, key: tuple) -> None:
        if self.last is not None and key < self.last:
            raise ValueError(f"rows must come ordered by {self.what}: {key} came after {self.last}")
        self.last = key


class SendPairs:
    """``pregel_send(TABLE(blocks) PARTITION BY (id, x, y) ORDER BY (side, edge))``: what each node tells
    its neighbours of each other, as (id, edge, value): to neighbour ``id`` that ``edge`` is one as
    well, from ``value``; ``id`` < ``edge``, each pair once.

    ``blocks`` is the table of :func:`neighbour_blocks`: a node's neighbours in blocks, and each
    pair of blocks a partition of its own.  The first block is held, the second streamed past it.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _wire(rows, ("id", "edge", "side", "x", "y"))
        return AnalyzeResult(StructType().add("id", LongType()).add("edge", LongType()).add("value", DoubleType()))

    def __init__(self) -> None:
        self.held: list[int] = []
        self.key, self.order = None, _InOrder("side, edge")

    def eval(self, row) -> Iterator[tuple]:
        key = (row["id"], row["x"], row["y"])
        if key != self.key:
            self.key, self.held, self.order = key, [], _InOrder("side, edge")
        other = row["edge"]
        self.order((row["side"], other))
        if row["side"] == 0:
            if row["x"] == row["y"]:
                for mine in self.held:
                    yield mine, other, float(row["id"])
            self.held.append(other)
        else:
            for mine in self.held:
                yield (mine, other, float(row["id"])) if mine < other else (other, mine, float(row["id"]))


class _Closing:
    """Reads edges and messages by (id, edge), the edge first, and tells which messages are about
    an edge that exists."""

    def __init__(self) -> None:
        self.key, self.exists, self.messages, self.order = None, False, False, _InOrder("id, edge")

    def closes(self, row) -> bool:
        key = (row["id"], row["edge"])
        if key != self.key:
            self.order(key)
            self.key, self.exists, self.messages = key, False, False
        if row["value"] is None:
            if self.messages:
                raise ValueError(f"rows must come ordered by id, edge, value, nulls first: edge {key} came after a message")
            self.exists = True
            return False
        self.messages = True
        return self.exists


class PernodeTriangles(_Closing):
    """``pregel_pernode_triangle(TABLE(t) PARTITION BY id % n ORDER BY (id, edge, value))``: (id,
    triangles), in parts to be added up: where a message of :class:`SendPairs` is about an edge
    that exists, sender, receiver and the node asked about have a triangle.

    ``t`` holds edges (a null value) and messages; of rows with one (id, edge) the edge comes
    first, as nulls do.  Rows with a null edge say nothing.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _wire(rows)
        return AnalyzeResult(StructType().add("id", LongType()).add("triangles", LongType()))

    def __init__(self) -> None:
        super().__init__()
        self.found = 0

    def _ends(self) -> Iterator[tuple]:
        if self.found:
            yield self.key[0], self.found
            yield self.key[1], self.found
            self.found = 0

    def eval(self, row) -> Iterator[tuple]:
        if row["edge"] is None:
            return
        if (row["id"], row["edge"]) != self.key:
            yield from self._ends()
        if self.closes(row):
            self.found += 1
            yield int(row["value"]), 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._ends()


class Triangles(_Closing):
    """``pregel_triangle(TABLE(t) PARTITION BY id % n ORDER BY (id, edge, value))``: (triangles), one row
    a partition, to be added up."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _wire(rows)
        return AnalyzeResult(StructType().add("triangles", LongType()))

    def __init__(self) -> None:
        super().__init__()
        self.total = 0

    def eval(self, row) -> None:
        self.total += row["edge"] is not None and self.closes(row)

    def terminate(self) -> Iterator[tuple]:
        yield (self.total,)


class WeakTies:
    """``pregel_weak_ties(TABLE(t) PARTITION BY id % n ORDER BY id, threshold => 1000)``: (id, ties) of
    nodes with ``threshold`` pairs of neighbours or more that are not neighbours of each other.

    ``t`` holds edges (a null value) and the node's triangles, whole or in parts (a null edge).
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        _wire(rows)
        _whole("threshold", threshold, 0)
        return AnalyzeResult(StructType().add("id", LongType()).add("ties", DoubleType()))

    def __init__(self) -> None:
        self.id, self.degree, self.triangles, self.threshold, self.order = None, 0, 0, 0, _InOrder("id")

    def _node(self) -> Iterator[tuple]:
        ties = self.degree * (self.degree - 1) // 2 - self.triangles
        if self.id is not None and ties >= self.threshold:
            yield self.id, float(ties)

    def eval(self, row, threshold: int) -> Iterator[tuple]:
        self.threshold = threshold
        if row["id"] != self.id:
            yield from self._node()
            self.order((row["id"],))
            self.id, self.degree, self.triangles = row["id"], 0, 0
        if row["value"] is None:
            self.degree += row["edge"] is not None
        elif row["edge"] is None:
            self.triangles += int(row["value"])

    def terminate(self) -> Iterator[tuple]:
        yield from self._node()


class OverlapPairs:
    """``pregel_overlap(TABLE(t) PARTITION BY id % n ORDER BY (id, edge), threshold => 100)``: (n1, n2,
    overlap) of the pairs that ``threshold`` messages or more tell of.  ``value`` is how many
    messages a row stands for, so a pair may come as one row or in many."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        _wire(rows)
        _whole("threshold", threshold, 1)
        return AnalyzeResult(StructType().add("n1", LongType()).add("n2", LongType()).add("overlap", LongType()))

    def __init__(self) -> None:
        self.key, self.n, self.threshold, self.order = None, 0, 1, _InOrder("id, edge")

    def _pair(self) -> Iterator[tuple]:
        if self.key is not None and self.n >= self.threshold:
            yield (*self.key, self.n)

    def eval(self, row, threshold: int) -> Iterator[tuple]:
        self.threshold = threshold
        key = (row["id"], row["edge"])
        if key != self.key:
            yield from self._pair()
            self.order(key)
            self.key, self.n = key, 0
        self.n += int(row["value"])

    def terminate(self) -> Iterator[tuple]:
        yield from self._pair()


class StrongOverlap(OverlapPairs):
    """``pregel_strong_overlap(TABLE(t) PARTITION BY edge % n ORDER BY (edge, id), threshold => 100)``: (id,
    partners): with how many smaller nodes a node shares ``threshold`` neighbours or more.  ``t``
    is as for :class:`OverlapPairs`, with the larger node of a pair as ``edge``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        OverlapPairs.analyze(rows, threshold)
        return AnalyzeResult(StructType().add("id", LongType()).add("partners", LongType()))

    def __init__(self) -> None:
        super().__init__()
        self.id, self.partners, self.order = None, 0, _InOrder("edge, id")

    def _pair(self) -> Iterator[tuple]:
        self.partners += self.key is not None and self.n >= self.threshold
        return iter(())

    def _node(self) -> Iterator[tuple]:
        if self.partners:
            yield self.id, self.partners
        self.partners = 0

    def eval(self, row, threshold: int) -> Iterator[tuple]:
        self.threshold = threshold
        key = (row["edge"], row["id"])
        if key != self.key:
            self._pair()
            self.order(key)
            if row["edge"] != self.id:
                yield from self._node()
                self.id = row["edge"]
            self.key, self.n = key, 0
        self.n += int(row["value"])

    def terminate(self) -> Iterator[tuple]:
        self._pair()
        yield from self._node()


FUNCTIONS = {
    "pregel_send": SendPairs, "pregel_triangle": Triangles, "pregel_pernode_triangle": PernodeTriangles,
    "pregel_weak_ties": WeakTies, "pregel_overlap": OverlapPairs, "pregel_strong_overlap": StrongOverlap,
}


def register(spark: SparkSession) -> None:
    """Make the table functions of this module, and those over lists, callable from SQL by name."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler))
    for name, (handler, schema) in list_functions.FUNCTIONS.items():
        spark.udtf.register(name, F.arrow_udtf(handler, returnType=schema))


def neighbour_blocks(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, edge, side, x, y): the neighbours (``edge``) of each ``id`` in blocks of about ``block``,
    and for each two blocks x <= y of a node the rows of both: those of x on side 0, those of y on
    side 1.  A node of ``block`` neighbours or fewer has one block and its rows come once; one
    with a million is many partitions, none of which holds more than two blocks.

    Columns of ``edges``: ``id``, ``edge``.  Repeated rows go, and so do rows with a null in either.
    """
    return _blocks(edges.select("id", "edge").where("id IS NOT NULL AND edge IS NOT NULL").distinct(), block)


def _blocks(simple: DataFrame, block: int) -> DataFrame:
    """As :func:`neighbour_blocks`; repeated rows stay.  Only hubs are looked up: they are few, and
    are written, so that Spark knows how few before it shuffles the edges to them."""
    hubs = written(simple.groupBy("id").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1"), "hubs")
    of = simple.join(hubs, "id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("edge"), F.col("blocks")).cast("int"))
    met = of.select("id", "edge", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"))
    return met.select("id", "edge", F.when(F.col("t") < F.col("b"), 1).otherwise(0).alias("side"), F.least("b", "t").alias("x"), F.greatest("b", "t").alias("y"))


def _views(**tables: DataFrame) -> dict[str, DataFrame]:
    spark = next(iter(tables.values())).sparkSession
    register(spark)
    return tables


#: The first superstep in SQL; {blocks}: neighbour blocks.  A partition has many nodes.
SENT = "pregel_send_lists(TABLE({blocks}) PARTITION BY (pmod(xxhash64(id, x, y), 1000)) ORDER BY (id, x, y, side, edge))"


def _sent(edges: DataFrame, block: int, columns: str) -> DataFrame:
    """What the nodes ``id`` of ``edges`` (id, edge) tell their neighbours of each other."""
    known = edges.where("id IS NOT NULL AND edge IS NOT NULL")
    return edges.sparkSession.sql(f"SELECT {columns} FROM {SENT}", **_views(blocks=_blocks(known, block)))


def closed_pairs(forward: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (id, edge, value, width, others) of the second superstep: edges from the larger id to the
    smaller, and the lists that the first superstep sends.

    ``forward`` has (a, b), each undirected edge once, from the end of lower degree, so that no
    node sends about more than some sqrt(2E) neighbours.
    """
    forward = forward.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    sent = _sent(forward.select(F.col("a").alias("id"), F.col("b").alias("edge")), block, "id, CAST(NULL AS BIGINT) AS edge, value, width, others")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("value", "bigint"), ("width", "tinyint"), ("others", "binary"))]
    return forward.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("edge"), *none).unionByName(sent)


def _counted(name: str, rows: DataFrame, columns: str, partitions: int, order: str, *more: str, end: str = "") -> DataFrame:
    """``columns`` of a table function that counts, by id over so many partitions."""
    call = f"{name}({', '.join([f'TABLE({{rows}}) PARTITION BY (id % {int(partitions)}) ORDER BY ({order})', *more])})"
    return rows.sparkSession.sql(f"SELECT {columns} FROM {call}{end}", **_views(rows=rows))


def triangles_in_sql(wire: DataFrame, partitions: int = 16) -> DataFrame:
    """(triangles) of the rows of :func:`closed_pairs`."""
    rows = wire.select("id", "edge", F.lit(0).cast("bigint").alias("value"), "width", "others")
    return _counted("pregel_triangle_lists", rows, "coalesce(sum(triangles), 0) AS triangles", partitions, "id, edge NULLS LAST")


def pernode_triangles_in_sql(wire: DataFrame, partitions: int = 16) -> DataFrame:
    """(id, triangles) of the rows of :func:`closed_pairs`."""
    return _counted("pregel_pernode_triangle_lists", wire, "id, sum(triangles) AS triangles", partitions, "id, edge NULLS LAST", end=" GROUP BY id")


def weak_ties_in_sql(edges: DataFrame, triangles: DataFrame, threshold: int, partitions: int = 16) -> DataFrame:
    """(id, ties) from edges (from_node, to_node), both directions, and (id, triangles)."""
    # that there is an edge is all that is asked
    wire = edges.select(F.col("from_node").cast("bigint").alias("id"), F.when(F.col("to_node").isNotNull(), 0).cast("bigint").alias("edge"), F.lit(None).cast("double").alias("value"))
    wire = wire.unionByName(triangles.select("id", F.lit(None).cast("bigint").alias("edge"), F.col("triangles").cast("double").alias("value")))
    return _counted("pregel_weak_ties_batches", wire, "*", partitions, "id", f"threshold => {int(threshold)}")


def overlap_messages(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, width, others): what receivers tell their senders (``from_node``) of each other, the larger
    of each two of the smaller."""
    return _sent(edges.select(F.col("to_node").cast("bigint").alias("id"), F.col("from_node").cast("bigint").alias("edge")), block, "id, width, others")


def strong_overlap_in_sql(messages: DataFrame, threshold: int, per_node: bool = False, partitions: int = 16) -> DataFrame:
    """(n1, n2, overlap), or with ``per_node`` (id, partners), of :func:`overlap_messages`."""
    return _counted("pregel_strong_overlap_lists" if per_node else "pregel_overlap_lists", messages, "*", partitions, "id", f"threshold => {int(threshold)}")

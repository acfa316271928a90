"""A vertex-centric API whose messages and vertex programs are Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.lineage import forget, written
from weftgraph.sources.layout import BySender

#: Names that expressions can use: the vertex's columns by name, a message's combined value as
#: ``msg``, the superstep as ``superstep``; in a message, edge columns by name and the sender's as
#: ``src.<name>``.  An expression may also be a function of the global values (a dict) that gives one.
Expr = str | Column
Given = Expr | Callable[[dict], Expr]


def _col(e: Given, globals_: dict | None = None) -> Column:
    if callable(e) and not isinstance(e, Column):
        e = e(globals_ or {})
    return F.expr(e) if isinstance(e, str) else e


@dataclass(frozen=True)
class Aggregator:
    """A global value over the vertices after each superstep.

    ``value`` is an aggregate over their columns, and over ``old_<name>`` for what these were before
    the superstep.  With ``combine`` the value is persistent: what the superstep gives is combined
    with what all before gave (null counts as nothing); without, each superstep starts anew.
    """

    value: Expr
    combine: Callable[[Any, Any], Any] | None = None

    def after(self, before: Any, now: Any) -> Any:
        if self.combine is None or before is None or now is None:
            return now if self.combine is None or before is None else before
        return self.combine(before, now)


class WrongAggregate(RuntimeError):
    """A check of the master's that did not hold."""


class Master:
    """What the master sees before a superstep, and what it can do about it.

    ``superstep``: the one about to run, from 0.  ``aggregates``: global values by name, as of the
    end of the superstep before (none before the first).  ``vertices`` and ``edges``: how many
    there are.
    """

    def __init__(self, superstep: int, aggregates: dict, vertices: int, edges: int):
        self.superstep, self.vertices, self.edges = superstep, vertices, edges
        self.aggregates = MappingProxyType(aggregates)
        self.halted, self.values = False, {}

    def halt(self) -> None:
        """End the run; this superstep does not take place."""
        self.halted = True

    def set(self, **values: Any) -> None:
        """Global values for this superstep's expressions and all later ones, until set again."""
        self.values |= values

    def require(self, holds: bool, what: str) -> None:
        """Stop the run with an error unless ``holds``."""
        if not holds:
            raise WrongAggregate(f"before superstep {self.superstep}: {what} ({dict(self.aggregates)})")


@dataclass
class Pregel:
    """Supersteps over a graph, whose edges are dealt by sender once (:class:`BySender`).

    ``initial``: columns of the vertex state.  ``send``: the message along each out-edge of an
    active vertex; null sends none.  ``send_to``: further messages, an array of structs (dst, msg)
    of the vertex's own state.  ``combine``: how a vertex's messages become one.  ``program``: new
    state columns.  ``active``: whether a vertex sends in the next superstep; by default always.
    With ``needs_message`` only vertices that got a message run their program; else all do, with
    a null ``msg`` where there is none.  ``aggregators``: global values over the state after each
    superstep, for the driver, the master and later supersteps' expressions.  ``master``: runs
    before each superstep; it can halt, set global values, or raise.  ``on_superstep``
    sees each superstep's end, ``on_end`` the last global values.
    """

    graph: Graph
    initial: dict[str, Expr]
    combine: Callable[[Column], Column]
    program: dict[str, Given]
    send: Given | None = None
    send_to: Given | None = None
    active: Given = "true"
    needs_message: bool = False
    aggregators: dict[str, Aggregator | Column] = field(default_factory=dict)
    master: Callable[[Master], None] | None = None
    on_superstep: Callable[[int, dict], None] | None = None
    on_end: Callable[[dict], None] | None = None
    history: list[dict] = field(default_factory=list)

    def _messages(self, state: DataFrame, edges: BySender, globals_: dict) -> DataFrame:
        sending = state.where("active")
        parts = []
        if self.send is not None:
            struct = F.struct(*[c for c in state.columns if c != "active"]).alias("src")
            met = edges.meet(sending.select(F.col("id").alias("from_node"), struct))
            parts.append(met.select(F.col("to_node").alias("dst"), _col(self.send, globals_).alias("m")))
        if self.send_to is not None:
            parts.append(sending.select(F.explode(_col(self.send_to, globals_)).alias("x")).select(F.col("x.dst").alias("dst"), F.col("x.msg").alias("m")))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # partial aggregation combines a task's messages before they are shuffled
        return out.where("m IS NOT NULL").groupBy("dst").agg(self.combine(F.col("m")).alias("msg"))

    def _aggregated(self, rows: DataFrame, before: dict) -> dict:
        named = {n: a if isinstance(a, Aggregator) else Aggregator(a) for n, a in self.aggregators.items()}
        now = rows.agg(*[_col(a.value).alias(n) for n, a in named.items()]).first().asDict()
        return {n: a.after(before.get(n), now[n]) for n, a in named.items()}

    def run(self, max_supersteps: int = 100) -> DataFrame:
        """The state (id and the columns) after no vertex sends, the master halts, or
        ``max_supersteps``."""
        with BySender(self.graph.edges) as edges:
            return self._supersteps(edges, max_supersteps)

    def _supersteps(self, edges: BySender, max_supersteps: int) -> DataFrame:
        names = list(self.initial)
        state = self.graph.nodes.select("id", *[_col(e).alias(n) for n, e in self.initial.items()]).withColumn("active", F.lit(True))
        state = stored = written(state, "vertices")
        n_vertices, n_edges = (stored.count(), edges.table.count()) if self.master is not None else (0, 0)
        aggregates: dict = {}
        set_by_master: dict = {}
        for i in range(max_supersteps):
            if self.master is not None:
                master = Master(i, dict(aggregates), n_vertices, n_edges)
                self.master(master)
                if master.halted:
                    break
                set_by_master |= master.values
            globals_ = aggregates | set_by_master
            messages = written(self._messages(state, edges, globals_), "messages")
            if messages.isEmpty():
                forget(messages)
                break
            met = state.join(messages, F.col("id") == F.col("dst"), "left").withColumn("superstep", F.lit(i))
            runs = F.col("msg").isNotNull() if self.needs_message else F.lit(True)
            changed = {n: F.when(runs, _col(self.program[n], globals_)).otherwise(F.col(n)) if n in self.program else F.col(n) for n in names}
            before = [F.col(n).alias(f"old_{n}") for n in names]
            after = met.select("id", "msg", "superstep", *before, *[c.alias(n) for n, c in changed.items()])
            # what was before stays with the written rows only where a global value may ask for it
            kept = [f"old_{n}" for n in names] if self.aggregators else []
            after = after.select("id", *names, *kept, F.coalesce(runs & _col(self.active, globals_), F.lit(False)).alias("active"))
            old, stored = stored, written(after, "vertices")
            state = stored.select("id", *names, "active")
            if self.aggregators:
                aggregates = self._aggregated(stored, aggregates)
                self.history.append(aggregates)
            if self.on_superstep is not None:
                self.on_superstep(i, aggregates)
            forget(old)
            forget(messages)
        if self.on_end is not None:
            self.on_end(dict(aggregates))
        return state.drop("active")


def _pagerank(graph: Graph, damping: float, **more: Any) -> Pregel:
    n = graph.nodes.count()
    degrees = graph.out_degrees().withColumnRenamed("id", "from_node")
    edges = graph.edges.join(degrees, "from_node").select("from_node", "to_node", (F.lit(1.0) / F.col("degree")).alias("share"))
    return Pregel(
        Graph(graph.nodes, edges), {"value": F.lit(1.0 / max(n, 1))}, F.sum, {"value": f"{(1 - damping)}D / {max(n, 1)} + {damping}D * coalesce(msg, 0D)"},
        send="src.value * share", **more,
    )


def pregel_pagerank(graph: Graph, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, value) of PageRank by supersteps; dangling mass is not given out again."""
    return _pagerank(graph, damping).run(iterations)


def pregel_pagerank_until(graph: Graph, tolerance: float = 1e-6, damping: float = 0.85, max_iterations: int = 200) -> tuple[DataFrame, DataFrame]:
    """PageRank by supersteps until the ranks change by less than ``tolerance`` in all (L1), which
    the master sees to: (id, value), and one row of what it saw: iterations, change (of the last),
    low and high (least and greatest rank in any superstep).

    The master also holds the number of ranks against the number of vertices, and raises where a
    superstep lost any.  A graph without nodes takes no superstep; the row's values are null.
    """
    aggregators = {
        "vertices": Aggregator("count(value)"), "change": Aggregator("sum(abs(value - old_value))"),
        "low": Aggregator("min(value)", min), "high": Aggregator("max(value)", max),
    }

    def master(m: Master) -> None:
        if m.superstep:
            m.require(m.aggregates["vertices"] == m.vertices, f"there should be {m.vertices} ranks")
            if m.aggregates["change"] < tolerance:
                m.halt()

    p = _pagerank(graph, damping, aggregators=aggregators, master=master)
    ranks = p.run(max_iterations)
    last = p.history[-1] if p.history else dict.fromkeys(aggregators)
    row = (len(p.history), last["change"], last["low"], last["high"])
    report = graph.edges.sparkSession.createDataFrame([row], "iterations int, change double, low double, high double")
    return ranks, report


def pregel_shortest_paths(graph: Graph, source: int, weight: str | None = None) -> DataFrame:
    """(id, value): least distance from ``source``, null where it is not reached."""
    w = weight or "1D"
    p = Pregel(
        graph, {"value": F.when(F.col("id") == source, F.lit(0.0))}, F.min, {"value": "least(value, msg)"},
        send=f"src.value + {w}", active="old_value IS NULL OR value < old_value", needs_message=True,
    )
    return p.run(1_000_000)


def pregel_components(graph: Graph) -> DataFrame:
    """(id, value): the least id of the weakly connected component."""
    p = Pregel(
        graph.symmetric(), {"value": "id"}, F.min, {"value": "least(value, msg)"},
        send="src.value", active="value < old_value", needs_message=True,
    )
    return p.run(1_000_000)

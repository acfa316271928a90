"""What a Pregel master sees and can do."""

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.pregel import Aggregator, Master, Pregel, WrongAggregate, pregel_pagerank, pregel_pagerank_until

CHAIN = [(i, i + 1) for i in range(8)] + [(8, 0), (2, 5)]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.from_edges(spark.createDataFrame(CHAIN, "from_node bigint, to_node bigint")).materialised()


def counting(graph, **more):
    """Each vertex adds up what it hears; all send 1."""
    return Pregel(graph, {"n": F.lit(0)}, F.sum, {"n": "CAST(n + coalesce(msg, 0) AS INT)"}, send="1", **more)


def test_master_sees_each_superstep_and_halts(graph):
    seen = []

    def master(m: Master):
        seen.append((m.superstep, dict(m.aggregates), m.vertices, m.edges))
        if m.aggregates.get("total", 0) >= 30:
            m.halt()

    p = counting(graph, aggregators={"total": Aggregator("sum(n)"), "moved": F.sum(F.expr("n - old_n"))}, master=master)
    total = p.run(50).agg(F.sum("n")).first()[0]
    assert total == 30 and seen == [(i, {"total": 10 * i, "moved": 10} if i else {}, 9, 10) for i in range(4)]
    assert p.history == [{"total": 10 * i, "moved": 10} for i in (1, 2, 3)]


def test_the_end_is_told(graph):
    told = []
    counting(graph, aggregators={"total": Aggregator("sum(n)")}, on_end=told.append, on_superstep=lambda i, values: told.append((i, values["total"]))).run(2)
    assert told == [(0, 10), (1, 20), {"total": 20}]


def test_halt_before_the_first_superstep(graph):
    p = counting(graph, master=lambda m: m.halt())
    assert {r["n"] for r in p.run().collect()} == {0} and p.history == []


def test_master_sets_values_for_expressions(graph):
    p = counting(graph, master=lambda m: m.set(step=m.superstep + 1) if m.superstep < 2 else None)
    p.send = lambda g: f"{g['step']}"
    assert p.run(3).agg(F.sum("n")).first()[0] == 10 * (1 + 2 + 2)  # a value stays until it is set again


def test_persistent_aggregators(graph):
    def program(g):
        return f"CASE WHEN id = 0 THEN {(-1) ** g['at']} * 100 * ({g['at']} + 1) ELSE n END"

    def run(**combined):
        aggregators = {"low": Aggregator("min(n)", combined.get("low")), "high": Aggregator("max(n)", combined.get("high"))}
        p = Pregel(graph, {"n": F.lit(0)}, F.sum, {"n": program}, send="1", aggregators=aggregators, master=lambda m: m.set(at=m.superstep))
        p.run(3)
        return p.history

    assert run() == [{"low": 0, "high": 100}, {"low": -200, "high": 0}, {"low": 0, "high": 300}]
    assert run(low=min, high=max) == [{"low": 0, "high": 100}, {"low": -200, "high": 100}, {"low": -200, "high": 300}]
    assert Aggregator("x", min).after(None, 3) == 3 and Aggregator("x", min).after(3, None) == 3 and Aggregator("x").after(3, None) is None


def test_a_check_that_does_not_hold_raises(graph):
    p = counting(graph, aggregators={"total": Aggregator("sum(n)")}, master=lambda m: m.require(m.superstep < 2 or m.aggregates["total"] == 10, "total stays 10"))
    with pytest.raises(WrongAggregate, match="before superstep 2: total stays 10"):
        p.run(5)
    with pytest.raises(TypeError):
        Master(0, {"a": 1}, 1, 1).aggregates["a"] = 2


def test_pagerank_until_small_change(spark, graph):
    ranks, report = pregel_pagerank_until(graph, 1e-4)
    row = report.first()
    value, low, high = dict.fromkeys(range(9), 1 / 9), [], []
    for _ in range(row["iterations"]):
        old = value
        out = {a: sum(x == a for x, _ in CHAIN) for a, _ in CHAIN}
        value = {v: 0.15 / 9 + 0.85 * sum(old[a] / out[a] for a, b in CHAIN if b == v) for v in range(9)}
        low.append(min(value.values()))
        high.append(max(value.values()))
    change = sum(abs(value[v] - old[v]) for v in range(9))
    assert change < 1e-4 and row["change"] == pytest.approx(change)
    assert row["low"] == pytest.approx(min(low)) and row["high"] == pytest.approx(max(high))
    assert {r["id"]: pytest.approx(r["value"]) for r in ranks.collect()} == value
    same = {r["id"]: r["value"] for r in pregel_pagerank(graph, row["iterations"]).collect()}
    assert {r["id"]: r["value"] for r in ranks.collect()} == same
    empty = Graph(spark.createDataFrame([], "id bigint"), spark.createDataFrame([], "from_node bigint, to_node bigint"))
    assert tuple(pregel_pagerank_until(empty)[1].first()) == (0, None, None, None)

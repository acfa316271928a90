"""Registered queries read the whole edge table; sources, sinks and isolated nodes come from a thin graph."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph import catalog
from weftgraph.functions.transforms import transform
from weftgraph.graph import Graph
from weftgraph.operators import neighbourhoods, paths, ranks, relational
from weftgraph.operators.components import connected_components
from weftgraph.sources.derived import EDGE, Derived


def plain_gcd(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a + 2].add(b + 2)
    want = {}
    for u, to in out.items():
        above = [v for v in to if v > u and v in out]
        if above:
            g = math.gcd(math.prod(above), *[v * math.prod(out[v]) for v in above])
            if g != u:
                want[u] = str(g)
    return want


def test_cliques_gcd_of_the_whole_table(spark, data):
    import __spark_entry__

    got = {r["from_node"]: r["gcd"] for r in __spark_entry__.queries()["cliques_gcd"](spark, data).collect()}
    assert got == plain_gcd([tuple(r) for r in Derived(spark, data).edge.collect()])


def test_queries_read_every_edge(spark, data):
    n = Derived(spark, data).edge.count()
    run = lambda name: catalog.QUERIES[name](spark, data)
    assert run("update_from").agg(F.sum("value")).first()[0] == n
    assert run("udtf_wire_encode").where("edge IS NOT NULL").count() == n
    assert run("udtf_wire_decode").agg(F.sum("edges")).first()[0] == n
    for a, b in (("connected_components", "component"), ("pregel_cc", "value")):
        assert run(a).select(b).distinct().count() == 1  # the whole graph hangs together
    whole = {r["id"]: r["value"] for r in run("pagerank").collect()}
    assert {r["id"]: r["value"] for r in run("pagerank_sparse").collect()} == pytest.approx(whole, abs=1e-7)
    assert {r["id"] for r in run("pagerank_inner").collect()} == set(whole)


@pytest.fixture(scope="module")
def thin(spark, data):
    d = Derived(spark, data)
    return Graph(d.node, d.sql(EDGE + " AND a.l_orderkey % 20 = 0")).materialised()


def test_thin_graph(spark, thin):
    ids, edges = [r[0] for r in thin.nodes.collect()], [tuple(r) for r in thin.edges.select("from_node", "to_node").collect()]
    heads, tails = {b for _, b in edges}, {a for a, _ in edges}
    assert set(ids) - heads and set(ids) - tails and set(ids) - heads - tails and heads - tails and tails - heads
    low = {i: i for i in ids}
    while True:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    assert {r["id"]: r["component"] for r in connected_components(thin.nodes, thin.edges).collect()} == low
    wire = relational.encode_wire(thin.nodes.withColumn("value", F.lit(0.0)), thin.edges)
    assert {r["id"]: r["value"] for r in transform("pregel_cc", wire).collect()} == low
    nodes, back = relational.decode_wire(wire)
    assert sorted(r["id"] for r in nodes.collect()) == sorted(ids) and sorted((r["from_node"], r["to_node"]) for r in back.collect()) == sorted(edges)
    into, out = defaultdict(list), defaultdict(int)
    for a, b in edges:
        into[b].append(a)
        out[a] += 1
    found = thin.in_degrees().withColumnRenamed("degree", "value")
    got = paths.merge_state(thin.nodes.select("id", F.lit(0).cast("bigint").alias("value")), found)
    assert {r["id"]: r["value"] for r in got.collect()} == {i: len(into[i]) for i in ids}
    for mode in ("standard", "inner"):
        r = dict.fromkeys(ids, 1 / len(ids))
        for _ in range(3):
            given = {i: [r[a] / out[a] for a in into[i] if a in r] for i in ids}
            r = {i: 0.15 / len(ids) + 0.85 * sum(g) for i, g in given.items() if g or mode == "standard"}
        assert {x["id"]: x["value"] for x in ranks.pagerank(thin, 3, mode=mode).collect()} == pytest.approx(r)
    shifted = Graph.from_edges(spark.createDataFrame([(a + 2, b + 2) for a, b in edges], "from_node bigint, to_node bigint"))
    assert {r["from_node"]: r["gcd"] for r in neighbourhoods.cliques_gcd(shifted).collect()} == plain_gcd(edges)

"""Table functions called from SQL, over few and many partitions, and what they refuse."""

import itertools

import pytest

from weftgraph.functions import table_functions as T
from weftgraph.graph import Graph
from weftgraph.operators import neighbourhoods as N
from weftgraph.plans.lineage import written

HUB = [(0, i) for i in range(1, 41)] + [(i, i + 1) for i in range(1, 40, 3)] + [(50, 51), (51, 52), (50, 52), (52, 53)]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(a, b) for a, b in HUB] + [(b, a) for a, b in HUB]
    return Graph.from_edges(spark.createDataFrame(rows, "from_node bigint, to_node bigint")).materialised()


def neighbours():
    out = {}
    for a, b in HUB:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


@pytest.mark.parametrize(("block", "parts"), [(10_000, 1), (10_000, 2), (3, 7), (1, 2)])
def test_counts_from_sql(graph, block, parts):
    nb = neighbours()
    corners = [t for t in itertools.combinations(sorted(nb), 3) if t[1] in nb[t[0]] and t[2] in nb[t[0]] & nb[t[1]]]
    of = {v: sum(v in t for t in corners) for v in nb}
    wire = written(T.closed_pairs(N.ranked_edges(graph), block), "wire")
    assert T.triangles_in_sql(wire, parts).first()["triangles"] == len(corners)
    found = T.pernode_triangles_in_sql(wire, parts)
    assert {r["id"]: r["triangles"] for r in found.collect()} == {v: n for v, n in of.items() if n}
    ties = {v: len(nb[v]) * (len(nb[v]) - 1) / 2 - of[v] for v in nb}
    got = T.weak_ties_in_sql(graph.edges, found, 1, parts).collect()
    assert {r["id"]: r["ties"] for r in got} == {v: n for v, n in ties.items() if n >= 1}
    shared = {(a, b): len(nb[a] & nb[b]) for a, b in itertools.combinations(sorted(nb), 2)}
    messages = written(T.overlap_messages(graph.edges, block), "messages")
    assert {(r["n1"], r["n2"]): r["overlap"] for r in T.strong_overlap_in_sql(messages, 2, False, parts).collect()} == {p: n for p, n in shared.items() if n >= 2}
    partners = {v: sum(n >= 2 for (_, b), n in shared.items() if b == v) for v in nb}
    assert {r["id"]: r["partners"] for r in T.strong_overlap_in_sql(messages, 2, True, parts).collect()} == {v: n for v, n in partners.items() if n}


def test_messages_need_not_be_added_up(spark):
    T.register(spark)
    rows = "SELECT * FROM VALUES (1L, 2L, 1D), (1L, 2L, 1D), (1L, 3L, 2D), (2L, 3L, 1D) AS t(id, edge, value)"
    got = spark.sql(f"SELECT * FROM pregel_overlap(TABLE({rows}) PARTITION BY (id % 2) ORDER BY (id, edge), threshold => 2)").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2), (1, 3, 2)]


def test_a_hub_is_cut_into_blocks(spark):
    edges = spark.range(1000).selectExpr("0L AS id", "id AS edge")
    blocks = T.neighbour_blocks(edges, 100)
    sizes = [r["count"] for r in blocks.groupBy("id", "x", "y").count().collect()]
    assert len(sizes) == 55 and max(sizes) < 400
    assert T.neighbour_blocks(edges.limit(0), 100).count() == 0
    odd = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (1, None)], "id bigint, edge bigint")
    assert [tuple(r) for r in T.neighbour_blocks(odd).collect()] == [(1, 2, 0, 0, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "from_node bigint, to_node bigint")
    wire = written(T.closed_pairs(none.selectExpr("from_node AS a", "to_node AS b")), "wire")
    assert T.triangles_in_sql(wire).first()["triangles"] == 0 and T.pernode_triangles_in_sql(wire).count() == 0
    assert T.strong_overlap_in_sql(T.overlap_messages(none), 1).count() == 0


@pytest.mark.parametrize(("call", "says"), [
    ("pregel_weak_ties(TABLE(SELECT 1L AS id, 'x' AS edge, 1D AS value), threshold => 3)", "edge must be a whole number"),
    ("pregel_weak_ties(TABLE(SELECT 1L AS id, 2L AS edge, 1D AS value), threshold => -3)", "at least 0"),
    ("pregel_weak_ties(TABLE(SELECT 1L AS id, 2L AS edge, 1D AS value), threshold => 1.5)", "constant whole number"),
    ("pregel_overlap(TABLE(SELECT 1L AS id, 2L AS edge, 1D AS value), threshold => 0)", "at least 1"),
    ("pregel_triangle(TABLE(SELECT 1L AS id, 2L AS edge))", "there is no value"),
    ("pregel_triangle(3)", "must be a table"),
    ("pregel_triangle(TABLE(SELECT 1L AS id, id AS edge, CAST(NULL AS DOUBLE) AS value FROM range(5)) PARTITION BY id ORDER BY edge DESC)", "ordered by id, edge"),
    ("pregel_triangle(TABLE(SELECT 1L AS id, 1L AS edge, IF(id = 0, NULL, 1D) AS value FROM range(2)) PARTITION BY id ORDER BY value NULLS LAST)", "came after a message"),
])
def test_refusals(spark, call, says):
    T.register(spark)
    with pytest.raises(Exception, match=says):
        spark.sql(f"SELECT * FROM {call}").collect()

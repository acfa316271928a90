"""Small graphs with known answers, and invariants."""

import itertools

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.transforms import transform
from weftgraph.graph import Graph
from weftgraph.operators import factors, neighbourhoods, paths, ranks, relational
from weftgraph.operators.components import component_labels, connected_components
from weftgraph.plans.pregel import Pregel, pregel_components, pregel_pagerank, pregel_shortest_paths


def graph(spark, edges, nodes=None, both=True):
    edges = [*edges, *[(b, a) for a, b in edges]] if both else edges
    ids = nodes if nodes is not None else sorted({v for e in edges for v in e})
    return Graph(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(edges, "from_node bigint, to_node bigint"))


K4 = list(itertools.combinations(range(1, 5), 2))
BOW_TIE = [(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)]
PATH = [(1, 2), (2, 3), (3, 4)]


def as_dict(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def test_k4(spark):
    g = graph(spark, K4)
    assert neighbourhoods.triangle_count(g).first()[0] == 4
    assert as_dict(neighbourhoods.triangles_per_node(g), "triangles") == dict.fromkeys(range(1, 5), 3.0)
    assert neighbourhoods.weak_ties(g, 0).count() == 0
    assert {tuple(r) for r in neighbourhoods.strong_overlap(g, 1).collect()} == {(a, b, 2) for a, b in K4}
    assert neighbourhoods.strong_overlap(g, 2).count() == 0
    assert neighbourhoods.strong_overlap(g, 2, strict=False).count() == 6
    assert as_dict(neighbourhoods.maximal_cliques(g), "cliques") == {4: 1}


def test_bow_tie(spark):
    g = graph(spark, BOW_TIE)
    assert neighbourhoods.triangle_count(g).first()[0] == 2
    assert as_dict(neighbourhoods.triangles_per_node(g), "triangles") == {1: 1.0, 2: 1.0, 3: 2.0, 4: 1.0, 5: 1.0}
    assert as_dict(neighbourhoods.weak_ties(g, 0), "ties") == {3: 4.0}
    assert as_dict(neighbourhoods.maximal_cliques(g), "cliques") == {3: 1, 5: 1}


def test_path(spark):
    g = graph(spark, PATH)
    assert neighbourhoods.triangle_count(g).first()[0] == 0
    assert as_dict(neighbourhoods.triangles_per_node(g, include_zero=True), "triangles") == dict.fromkeys(range(1, 5), 0.0)
    assert as_dict(neighbourhoods.weak_ties(g, 0), "ties") == {2: 1.0, 3: 1.0}
    assert as_dict(paths.shortest_paths(g, 1), "value") == {1: 0, 2: 1, 3: 2, 4: 3}
    assert as_dict(paths.shortest_paths(g, 1, max_iter=2), "value") == {1: 0, 2: 1, 3: 2, 4: None}


def test_pagerank_of_a_chain(spark):
    g = graph(spark, [(1, 2), (2, 3)], both=False)
    third = 0.15 / 3 + 0.85 / 3
    assert as_dict(ranks.pagerank(g, 1), "value") == pytest.approx({1: 0.05, 2: third, 3: third})
    assert as_dict(ranks.pagerank(g, 1, mode="inner"), "value") == pytest.approx({2: third, 3: third})
    assert as_dict(pregel_pagerank(g, 1), "value") == pytest.approx({1: 0.05, 2: third, 3: third})
    with pytest.raises(ValueError):
        ranks.pagerank(g, mode="other")


def test_components(spark):
    g = graph(spark, [(1, 2), (3, 4)], nodes=range(1, 6), both=False)
    want = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert as_dict(connected_components(g.nodes, g.edges), "component") == want
    assert as_dict(pregel_components(g), "value") == want
    assert as_dict(paths.shortest_paths(g, 1), "value") == {1: 0, 2: 1, 3: None, 4: None, 5: None}
    assert as_dict(pregel_shortest_paths(g, 1), "value") == {1: 0, 2: 1, 3: None, 4: None, 5: None}


def test_components_of_a_long_path_and_a_star(spark):
    line = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    labels = component_labels(graph(spark, line + star, both=False).edges)
    assert {r["id"]: r["component"] for r in labels.collect()} == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_loops_duplicates_unknown_ends_and_empty_graphs(spark):
    edges = [(1, 2), (1, 2), (2, 1), (2, 2), (2, 9), (1, 3), (3, 1), (2, 3), (3, 2)]
    g = graph(spark, edges, nodes=[1, 2, 3], both=False)
    assert g.audit().first().asDict() == {"edges": 9, "distinct_edges": 8, "self_loops": 1, "reciprocal": 7, "dangling_ends": 1}
    assert neighbourhoods.triangle_count(Graph.from_edges(g.edges, g.nodes)).first()[0] == 1
    assert Graph.from_edges(g.edges).edges.count() == 8
    assert as_dict(connected_components(g.nodes, g.edges), "component") == {1: 1, 2: 1, 3: 1}
    empty = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert ranks.pagerank(empty).count() == 0
    assert connected_components(empty.nodes, empty.edges).count() == 0
    assert paths.shortest_paths(empty, 1).count() == 0
    assert neighbourhoods.triangle_count(empty).first()[0] == 0
    assert neighbourhoods.maximal_cliques(empty).count() == 0
    bad = Graph(spark.createDataFrame([(1,), (1,), (None,)], "id bigint"), spark.createDataFrame([(1, None)], "from_node bigint, to_node bigint"))
    assert len(bad.problems()) == 3


def test_cliques_gcd_of_k3(spark):
    g = graph(spark, [(2, 3), (2, 4), (3, 4)])
    assert {(r[0], r[1]) for r in neighbourhoods.cliques_gcd(g).collect()} == {(2, "12"), (3, "4")}


def test_one_rating(spark):
    ratings = spark.createDataFrame([(1, 10, 3.0)], "user bigint, item bigint, rating double")
    vec = {r["id"]: r["vec"] for r in factors.factorise(ratings, updates=1).collect()}
    assert vec[1] == pytest.approx([1.00495, 1.00495]) and vec[10] == pytest.approx([1.00495, 1.00495])
    assert factors.rmse(ratings, factors.factorise(ratings, updates=0)).first()["rmse"] == pytest.approx(1.0)


def test_histogram_clamps_at_the_top(spark):
    values = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,)], "value double")
    assert {r[0]: r[1] for r in relational.rank_histogram(values, 0, 10, 5).collect()} == {0: 1, 1: 1, 5: 2}


def test_rank_distance_join_with_missing_sides(spark):
    r = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.9)], "id bigint, value double")
    d = spark.createDataFrame([(2, 0.0), (3, 9.0), (4, 9.0)], "id bigint, value double")
    assert as_dict(relational.rank_distance_join(r, d, 0.5, 3), "value") == {1: 0.9, 2: 0.0, 3: 0.9}
    assert as_dict(relational.rank_distance_join(r, d, 0.5, 3, compat=True), "value") == {1: 0.0, 2: 0.0, 3: 0.9}


def test_transforms_do_not_depend_on_partitioning(spark):
    g = graph(spark, BOW_TIE + [(7, 8)])
    wire = relational.encode_wire(g.nodes.withColumn("value", F.lit(0.0)), g.edges)
    seen = []
    for n in (1, 3, 16):
        cut = wire.repartition(n)
        seen.append({name: sorted(map(tuple, transform(name, cut, **p).collect())) for name, p in (("pregel_cc", {}), ("pregel_sp", {"startNode": 1}), ("pregel_pernode_triangle", {}), ("pregel_weak_ties", {"threshold": 0}))})
    assert seen[0] == seen[1] == seen[2]
    with pytest.raises(ValueError):
        transform("nothing", wire)
    with pytest.raises(ValueError):
        transform("pregel_cc", wire.drop("edge"))


def test_pregel_aggregators_and_direct_messages(spark):
    g = graph(spark, PATH)
    seen = []
    p = Pregel(g, {"value": "id"}, F.sum, {"value": "coalesce(msg, 0L)"}, send="src.value", aggregators={"total": F.sum("value")}, on_superstep=lambda i, x: seen.append((i, x["total"])))
    p.run(2)
    assert seen[0] == (0, 15) and len(seen) == 2
    up = Pregel(g, {"value": "0L"}, F.sum, {"value": "msg"}, send_to="array(named_struct('dst', 1L, 'msg', id))", needs_message=True)
    assert as_dict(up.run(1), "value") == {1: 10, 2: 0, 3: 0, 4: 0}


def test_linerank_sums_by_head(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 1)], both=False)
    values = {(r[0], r[1]): r[2] for r in ranks.linerank(g, 3).collect()}
    assert values == pytest.approx(dict.fromkeys([(1, 2), (2, 3), (3, 1)], 1 / 3))
    assert as_dict(ranks.linerank_of_nodes(ranks.linerank(g, 1), g.nodes), "value") == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 1 / 3})

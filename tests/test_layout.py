"""Edges dealt by sender: what a superstep's plan shuffles, and hubs in several buckets."""

import os

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.lineage import shared_dir
from weftgraph.plans.pregel import Pregel
from weftgraph.sources import layout
from weftgraph.sources.layout import BySender


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, (i * 7 + 1) % 50) for i in range(50)] + [(3, i) for i in range(200, 320)]
    return spark.createDataFrame(rows, "from_node bigint, to_node bigint").distinct()


def met(spark, laid):
    state = spark.range(50).selectExpr("id AS from_node", "id + 0.5D AS value")
    return laid.meet(state).groupBy("to_node").agg(F.sum("value").alias("s"))


@pytest.mark.parametrize("hub_edges", [10, 1000])
def test_a_superstep_shuffles_no_edges(spark, edges, hub_edges, monkeypatch):
    monkeypatch.setattr(layout, "FEW_SENDERS", 0)
    with BySender(edges, hub_edges=hub_edges) as laid:
        plan = met(spark, laid)._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.splitlines() if laid.name in x and "FileScan" in x)
        assert "Bucketed: true" in scan and "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMerge", "Sort!")
        assert plan.count("Exchange hashpartitioning") == 2  # the state to its edges, and what they give to its receivers
        # none of the two is above the scan of the edges and below the join
        depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
        lines = plan.splitlines()
        at, join = lines.index(scan), max(i for i, x in enumerate(lines) if "ShuffledHashJoin" in x)
        assert not any("Exchange" in x for x in lines[join:at] if depth(x) < depth(scan))


@pytest.mark.parametrize("hub_edges", [7, 100, 1000])
def test_salted_hubs_meet_all_their_edges(spark, edges, hub_edges):
    want = {}
    for r in edges.collect():
        want[r["to_node"]] = want.get(r["to_node"], 0) + r["from_node"] + 0.5
    with BySender(edges, hub_edges=hub_edges) as laid:
        assert {r["to_node"]: r["s"] for r in met(spark, laid).collect()} == want
        assert laid.salted == (hub_edges < 121)
        if laid.salted:
            assert laid.table.where("from_node = 3").select("salt").distinct().count() > 1
        assert laid.table.count() == len(edges.collect())
        path = laid.path.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.exists(path) and not spark.catalog.tableExists(laid.name)


def test_a_run_leaves_no_table_of_edges(spark, edges):
    before = {t.name for t in spark.catalog.listTables()}
    p = Pregel(Graph.from_edges(edges), {"n": F.lit(0)}, F.sum, {"n": "nosuch + 1"}, send="1")
    with pytest.raises(Exception, match="nosuch"):
        p.run(2)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file://") + "/weftgraph") if f.startswith("by_sender")]
    assert BySender(edges.limit(0)).meet(spark.range(3).selectExpr("id AS from_node")).count() == 0

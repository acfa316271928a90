"""Table functions over wire rows (id, edge, value), by name and with named parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.neighbourhoods import overlap_per_node, triangle_count, triangles_per_node, weak_ties
from weftgraph.operators.relational import decode_wire
from weftgraph.plans.lineage import written
from weftgraph.plans.pregel import pregel_components, pregel_pagerank, pregel_shortest_paths


def _pr(graph: Graph, numIterations: int = 10, numNodes: int | None = None) -> DataFrame:  # noqa: N803
    found = graph.nodes.count()
    if numNodes not in (None, found):
        raise ValueError(f"numNodes is {numNodes}, but the table has {found}")
    return pregel_pagerank(graph, numIterations)


def _sp(graph: Graph, startNode: int, endNode: int | None = None) -> DataFrame:  # noqa: N803
    found = pregel_shortest_paths(graph, startNode)
    return found if endNode is None else found.where(F.col("id") == endNode)


#: What each name computes; parameters are passed by keyword.
TRANSFORMS = {
    "pregel_pr": _pr,
    "pregel_sp": _sp,
    "pregel_cc": lambda graph: pregel_components(graph),
    "pregel_triangle": lambda graph: triangle_count(graph),
    "pregel_pernode_triangle": lambda graph: triangles_per_node(graph),
    "pregel_weak_ties": lambda graph, threshold=1000: weak_ties(graph, threshold),
    "pregel_strong_overlap": lambda graph, threshold=100: overlap_per_node(graph, threshold),
}


def transform(name: str, wire: DataFrame, **parameters) -> DataFrame:
    """The named function over wire rows.  The result does not depend on how they are partitioned."""
    if name not in TRANSFORMS:
        raise ValueError(f"no function {name!r}; there are {', '.join(sorted(TRANSFORMS))}")
    missing = [c for c in ("id", "edge", "value") if c not in wire.columns]
    if missing:
        raise ValueError(f"wire rows need id, edge and value; there is no {', '.join(missing)}")
    nodes, edges = decode_wire(written(wire.select("id", "edge", "value"), "wire"))
    return TRANSFORMS[name](Graph(nodes, edges), **parameters)

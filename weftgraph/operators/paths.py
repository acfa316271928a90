"""Single-source shortest paths and merging of node state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.loops import fix_point


def improve(edges: DataFrame, frontier: DataFrame, state: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, value): nodes that the frontier reaches at less than their value (null: unreached)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    reached = frontier.select(F.col("id").alias("at"), F.col("value").alias("far")).join(edges, F.col("at") == F.col("from_node")).groupBy("to_node").agg(F.min(F.col("far") + w).alias("new_value"))
    better = state.join(reached, F.col("id") == F.col("to_node")).where(F.col("value").isNull() | (F.col("new_value") < F.col("value")))
    return better.select("id", F.col("new_value").alias("value"))


def merge_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state with the values of ``new`` where it has the node."""
    fresh = new.select(F.col("id").alias("new_id"), F.col("value").alias("new_value"))
    return state.join(fresh, F.col("id") == F.col("new_id"), "left").select("id", F.coalesce("new_value", "value").alias("value"))


def shortest_paths(graph: Graph, source: int, weight: str | None = None, max_iter: int | None = None, unreachable: float | None = None) -> DataFrame:
    """(id, value): least distance from ``source`` along out-edges, 1 an edge unless a ``weight``
    column of non-negative numbers is named; ``unreachable`` (null) where there is no path."""
    graph = graph.materialised()
    start = graph.nodes.select("id", F.when(F.col("id") == source, F.lit(0.0)).alias("value"))
    frontier = start.where("value IS NOT NULL")
    state = fix_point(start, frontier, lambda state, delta, _: improve(graph.edges, delta, state, weight), merge_state, max_iter)
    return state if unreachable is None else state.withColumn("value", F.coalesce("value", F.lit(float(unreachable))))

"""PageRank over nodes and LineRank over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.lineage import written
from weftgraph.plans.loops import iterate
from weftgraph.sources.layout import BySender


def outbound_step(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(id, new_value): what each node gives to each of its out-neighbours."""
    degree = edges.groupBy(F.col("from_node").alias("id")).agg(F.count("to_node").alias("degree"))
    return degree.join(state, "id").select("id", (F.col("value") / F.col("degree")).alias("new_value"))


def incoming_step(edges: DataFrame, outbound: DataFrame, n: int, damping: float = 0.85) -> DataFrame:
    """(id, value) of the nodes that get anything."""
    given = edges.join(outbound, F.col("from_node") == F.col("id")).groupBy("to_node").agg(F.sum("new_value").alias("s"))
    return given.select(F.col("to_node").alias("id"), (F.lit((1 - damping) / n) + F.lit(damping) * F.col("s")).alias("value"))


def pagerank(graph: Graph, iterations: int = 10, damping: float = 0.85, num_nodes: int | None = None, mode: str = "standard", every: int = 5) -> DataFrame:
    """(id, value) after ``iterations`` updates from 1/N; dangling mass is not given out again.

    ``standard`` keeps every node, one without in-edges at (1 - damping)/N.  ``inner`` drops, in
    each update, the nodes that get nothing, as plain joins do.  Each edge carries 1/out-degree
    from the start, so an update is one join on the sender and one sum by receiver.
    """
    if mode not in ("standard", "inner"):
        raise ValueError(f"mode {mode!r} is neither 'standard' nor 'inner'")
    n = num_nodes if num_nodes is not None else graph.nodes.count()
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("value"))
    degree = graph.out_degrees().withColumnRenamed("id", "from_node")
    shares = graph.edges.join(degree, "from_node").select("from_node", "to_node", (F.lit(1.0) / F.col("degree")).alias("share"))
    nodes = written(graph.nodes.select("id"), "nodes")
    # dealt by sender once: each update then shuffles ranks and sums, not edges
    with BySender(shares) as laid:

        def step(state: DataFrame, _: int) -> DataFrame:
            got = laid.meet(state.withColumnRenamed("id", "from_node")).groupBy("to_node").agg(F.sum(F.col("value") * F.col("share")).alias("s"))
            if mode == "inner":
                return got.select(F.col("to_node").alias("id"), (F.lit((1 - damping) / n) + damping * F.col("s")).alias("value"))
            return nodes.join(got, F.col("id") == F.col("to_node"), "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("s", F.lit(0.0))).alias("value"))

        return iterate(nodes.select("id", F.lit(1.0 / n).alias("value")), step, iterations, every)


def rank_summary(ranks: DataFrame) -> DataFrame:
    """One row: n, low, high, total of the values."""
    return ranks.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))


def linerank_outbound(edges: DataFrame) -> DataFrame:
    """(from_node, to_node, new_value): each edge's value over the number of edges that follow it.

    That number is the out-degree of its head, so edges meet nodes and never each other.
    """
    follow = edges.groupBy(F.col("from_node").alias("head")).agg(F.count("*").alias("n"))
    return edges.join(follow, F.col("to_node") == F.col("head")).select("from_node", "to_node", (F.col("value") / F.col("n")).alias("new_value"))


def linerank(graph: Graph, iterations: int = 10, damping: float = 0.85, num_edges: int | None = None, every: int = 5) -> DataFrame:
    """(from_node, to_node, value): rank of edges over the line graph, from 1/E.

    Edges whose tail ends no edge of the round before drop out, as plain joins do.  With repeated
    edges every copy follows every edge.

    An edge's rank depends on its tail alone, so the state of a round is a value a tail, and edges
    are dealt by tail once and only read in the rounds.  A tail stays if an edge of a tail that is
    still there ends in it.
    """
    e = num_edges if num_edges is not None else graph.edges.count()
    edges = written(graph.edges.select("from_node", "to_node"), "edges")
    degree = edges.groupBy("from_node").agg(F.count("*").alias("n"))
    start = written(degree.select(F.col("from_node").alias("tail"), "n", F.lit(1.0 / max(e, 1)).alias("value")), "tails")
    with BySender(edges) as laid:

        def step(state: DataFrame, _: int) -> DataFrame:
            ends = laid.meet(state.select(F.col("tail").alias("from_node"), "value")).groupBy("to_node").agg(F.sum("value").alias("s"))
            met = state.select("tail", "n").join(ends, F.col("tail") == F.col("to_node"))
            return met.select("tail", "n", (F.lit((1 - damping) / max(e, 1)) + damping * F.col("s") / F.col("n")).alias("value"))

        tails = iterate(start, step, iterations, every)
    return edges.join(tails.select(F.col("tail").alias("from_node"), "value"), "from_node").select("from_node", "to_node", "value")


def linerank_of_nodes(edge_ranks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, value): the sum of the ranks of a node's in-edges; nodes without any are absent."""
    sums = edge_ranks.groupBy(F.col("to_node").alias("id")).agg(F.sum("value").alias("value"))
    return sums.join(nodes.select("id"), "id", "left_semi")

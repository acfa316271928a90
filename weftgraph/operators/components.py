"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import written


def _star(pairs: DataFrame, bigger: bool) -> DataFrame:
    """One contraction step over pairs (a, b) with a > b.

    Large star: every node links its larger neighbours to the least node it sees, itself
    included.  Small star: every node links its smaller neighbours, and itself, to the least.
    Both keep connectivity.  The least neighbour comes from an aggregation, so a node with very
    many neighbours is no hot group; its rows meet that value in a join that AQE can split.
    """
    if bigger:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("w"))
    if bigger:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def component_labels(edges: DataFrame, src: str = "from_node", dst: str = "to_node", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every endpoint of ``edges``; component is the smallest id reachable.

    Directions do not matter; self-loops make their node a component of its own; null endpoints
    are left out.  The number of rounds grows with the logarithm of the longest path, not with
    the path.  After each round the pairs are written to the shared folder.
    """
    ends = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct()
    ends = written(ends, "ends")
    pairs, before = ends.where("a > b"), None
    for _ in range(max_rounds):
        pairs = written(_star(_star(pairs, True), False), "pairs")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select("b").unionAll(ends.where("a = b").select("b")).distinct()
    labels = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    alone = roots.join(pairs, roots.b == pairs.a, "left_anti")
    return labels.unionAll(alone.select(F.col("b").alias("id"), F.col("b").alias("component")))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; a node without edges is a component of its own.  Edges with
    an end that is no node do not connect."""
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi").join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi")
    labels = component_labels(inside).withColumnRenamed("id", "of")
    return ids.join(labels, F.col("id") == F.col("of"), "left").select("id", F.coalesce("component", "id").alias("component"))

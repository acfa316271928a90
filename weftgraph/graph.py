"""A graph as two DataFrames: nodes (id, ...) and edges (from_node, to_node, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import written


@dataclass(frozen=True)
class Graph:
    """Topology only; what an algorithm computes is a DataFrame of its own.

    ``nodes`` has unique, non-null ``id``; ``edges`` has ``from_node`` and ``to_node``, directed.
    Undirected graphs hold both directions.  Either may carry further columns.
    """

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, dedup: bool = True) -> Graph:
        """A graph whose nodes, unless given, are the endpoints.  Edges with a null endpoint go;
        with ``dedup`` so do repeated (from, to) pairs."""
        edges = edges.where("from_node IS NOT NULL AND to_node IS NOT NULL")
        if dedup:
            edges = edges.dropDuplicates(["from_node", "to_node"])
        if nodes is None:
            nodes = edges.select(F.col("from_node").alias("id")).union(edges.select("to_node")).distinct()
        return cls(nodes, edges)

    def materialised(self) -> Graph:
        """The graph with its edges written once, for algorithms that read them many times."""
        return Graph(self.nodes, written(self.edges, "graph"))

    def filter_edges(self, predicate: Column) -> Graph:
        """The view of edges that satisfy ``predicate``; all nodes stay.  The predicate reaches
        the scan, and no alias can escape it, whatever joins an algorithm makes."""
        return Graph(self.nodes, self.edges.where(predicate))

    def filter_nodes(self, predicate: Column) -> Graph:
        """The subgraph induced by the nodes that satisfy ``predicate``."""
        nodes = self.nodes.where(predicate)
        ids = nodes.select("id")
        inside = self.edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi")
        return Graph(nodes, inside.join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi").select(self.edges.columns))

    def reversed(self) -> Graph:
        others = [c for c in self.edges.columns if c not in ("from_node", "to_node")]
        return Graph(self.nodes, self.edges.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), *others))

    def symmetric(self) -> Graph:
        """Both directions of every edge, each once; edge columns other than the ends go."""
        ends = self.edges.select("from_node", "to_node")
        return Graph(self.nodes, ends.union(ends.select("to_node", "from_node")).distinct())

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("from_node").alias("id")).agg(F.count("*").alias("degree"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("to_node").alias("id")).agg(F.count("*").alias("degree"))

    def audit(self) -> DataFrame:
        """One row: edges, distinct_edges, self_loops, reciprocal (distinct edges whose reverse is
        there too), dangling_ends (distinct edges with an end that is no node)."""
        ends = self.edges.select("from_node", "to_node")
        distinct = ends.distinct()
        back = distinct.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node")).withColumn("back", F.lit(1))
        a = self.nodes.select(F.col("id").alias("from_node"), F.lit(1).alias("has_from"))
        b = self.nodes.select(F.col("id").alias("to_node"), F.lit(1).alias("has_to"))
        seen = distinct.join(back, ["from_node", "to_node"], "left").join(a, "from_node", "left").join(b, "to_node", "left")
        facts = seen.agg(
            F.count("*").alias("distinct_edges"), F.count_if(F.col("from_node") == F.col("to_node")).alias("self_loops"),
            F.count("back").alias("reciprocal"), F.count_if(F.col("has_from").isNull() | F.col("has_to").isNull()).alias("dangling_ends"),
        )
        # both sides are single rows
        return ends.agg(F.count("*").alias("edges")).withColumn("k", F.lit(1)).join(facts.withColumn("k", F.lit(1)), "k").drop("k")

    def problems(self) -> list[str]:
        """What is wrong with the tables: null or repeated ids, null endpoints."""
        found = []
        nulls, n, distinct = self.nodes.agg(F.count_if(F.col("id").isNull()), F.count("id"), F.count_distinct("id")).first()
        if nulls:
            found.append(f"{nulls} nodes have a null id")
        if n != distinct:
            found.append(f"{n - distinct} node rows repeat an id")
        nulls = self.edges.where("from_node IS NULL OR to_node IS NULL").count()
        if nulls:
            found.append(f"{nulls} edges have a null endpoint")
        return found

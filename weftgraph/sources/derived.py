"""Graphs derived from tables of orders; the SQL runs alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.graph import Graph

NODE = "SELECT p_partkey AS id FROM {part}"
EDGE = """SELECT DISTINCT a.l_partkey AS from_node, b.l_partkey AS to_node
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey"""
RATINGS = """SELECT o_custkey AS user, 10000000 + l_partkey AS item, CAST(MAX(1 + CAST(l_quantity AS BIGINT) % 5) AS DOUBLE) AS rating
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey"""
UEDGE = "SELECT from_node, to_node FROM {edge} UNION SELECT to_node, from_node FROM {edge}"
EDGE_META = """SELECT from_node, to_node,
CASE (from_node + to_node) % 3 WHEN 0 THEN 'Family' WHEN 1 THEN 'Friend' ELSE 'Classmate' END AS type,
CAST((from_node * 7 + to_node) % 100 AS INT) AS weight, '2014-01-01' AS timestamp FROM {edge}"""
NODE_META = "SELECT id, CAST(id % 10 AS INT) AS a6, CAST(id % 7 AS INT) AS a7, CAST(id % 100 AS DOUBLE) / 4 AS a33, CAST(id AS STRING) AS a51 FROM {node}"

TABLES = ("part", "lineitem", "orders")


def duck(sql: str, **views: str) -> str:
    """A fixture's SQL for DuckDB, with the names of tables and views put in."""
    return sql.format(**{t: t for t in TABLES} | views).replace("STRING", "VARCHAR")


class Derived:
    """The derived tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        used = {k: v for k, v in (self.tables | views).items() if "{" + k + "}" in text}
        return self.spark.sql(text, **used)

    @property
    def node(self) -> DataFrame:
        return self.sql(NODE)

    @property
    def edge(self) -> DataFrame:
        return self.sql(EDGE)

    @property
    def uedge(self) -> DataFrame:
        return self.sql(UEDGE, edge=self.edge)

    @property
    def edge_meta(self) -> DataFrame:
        return self.sql(EDGE_META, edge=self.edge)

    @property
    def uedge_meta(self) -> DataFrame:
        return self.sql(EDGE_META, edge=self.uedge)

    @property
    def node_meta(self) -> DataFrame:
        return self.sql(NODE_META, node=self.node)

    @property
    def ratings(self) -> DataFrame:
        return self.sql(RATINGS)

    def graph(self, edges: str = "edge") -> Graph:
        return Graph(self.node, getattr(self, edges))

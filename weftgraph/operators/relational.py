"""What comes before and after graph algorithms: histograms, joins of results, wire rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vectors import histogram_bucket


def rank_histogram(values: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """(bucket, count) of ``value``: 0 below ``low``, then ``n`` equal widths, the last with all
    from ``high`` on; buckets without rows are absent."""
    return values.groupBy(histogram_bucket(F.col("value"), low, high, n).alias("bucket")).agg(F.count("*").alias("count"))


def rank_distance_join(ranks: DataFrame, distances: DataFrame, rank_over: float, distance_under: float, compat: bool = False) -> DataFrame:
    """(id, value): the distance of nodes nearer than ``distance_under``, else the rank of those
    ranked over ``rank_over``; other nodes go.

    A missing distance is never near.  With ``compat`` it counts as 0, and so is always near.
    """
    d = distances.select(F.col("id").alias("d_id"), F.col("value").cast("double").alias("distance"))
    r = ranks.select("id", F.col("value").cast("double").alias("rank"))
    both = r.join(d, F.col("id") == F.col("d_id"), "full_outer").select(F.coalesce("id", "d_id").alias("id"), "rank", "distance")
    if compat:
        both = both.withColumn("distance", F.coalesce("distance", F.lit(0.0))).withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    value = F.when(F.col("distance") < distance_under, F.col("distance")).when(F.col("rank") > rank_over, F.col("rank"))
    return both.select("id", value.alias("value")).where("value IS NOT NULL")


def metadata_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """All fields of both tables by id, of ``a`` first; null where a table lacks the id."""
    right = b.withColumnRenamed("id", "right_id")
    both = a.join(right, F.col("id") == F.col("right_id"), "full_outer")
    return both.select(F.coalesce("id", "right_id").alias("id"), *[c for c in a.columns if c != "id"], *[c for c in b.columns if c != "id"])


def encode_wire(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One table (id, edge, value) of both: an edge has a null value, a node a null edge."""
    e = edges.select(F.col("from_node").alias("id"), F.col("to_node").alias("edge"), F.lit(None).cast("double").alias("value"))
    return e.unionByName(nodes.select("id", F.lit(None).cast("bigint").alias("edge"), F.col("value").cast("double").alias("value")))


def decode_wire(wire: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, value) and edges (from_node, to_node) of :func:`encode_wire`'s table."""
    nodes = wire.where("edge IS NULL").select("id", "value")
    return nodes, wire.where("edge IS NOT NULL").select(F.col("id").alias("from_node"), F.col("edge").alias("to_node"))

"""Degrees of a growing edge table, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of a streaming or static (from_node, to_node) table; as a
    stream it needs output mode complete or update."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_node").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_node").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))

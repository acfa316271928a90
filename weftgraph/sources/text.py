"""Delimited text with explicit schemas, and the ring generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("id", T.LongType())])
RANKED_NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType())])
LABELLED_NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.LongType())])
EDGES = T.StructType([T.StructField("from_node", T.LongType()), T.StructField("to_node", T.LongType())])
RATINGS = T.StructType([T.StructField("user", T.LongType()), T.StructField("item", T.LongType()), T.StructField("rating", T.DoubleType())])
META_EDGES = T.StructType([*EDGES.fields, T.StructField("type", T.StringType()), T.StructField("weight", T.IntegerType()), T.StructField("timestamp", T.StringType())])
SMALL_META_EDGES = T.StructType([*EDGES.fields, T.StructField("type", T.StringType()), T.StructField("weight", T.IntegerType())])
SMALL_META_NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("value", T.LongType())])


def meta_nodes(with_value: bool = True) -> T.StructType:
    """id, value, then a1 to a60: 32 whole numbers, 18 real ones, 10 texts."""
    kind = lambda i: T.IntegerType() if i <= 32 else T.DoubleType() if i <= 50 else T.StringType()
    head = [T.StructField("id", T.LongType())] + [T.StructField("value", T.DoubleType())] * with_value
    return T.StructType([*head, *[T.StructField(f"a{i}", kind(i)) for i in range(1, 61)]])


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = "\t", null: str = "null", on_error: str = "fail", where: Column | None = None) -> DataFrame:
    """Rows of delimited text.  ``on_error``: ``fail`` stops at a row that is not as the schema
    says, ``drop`` leaves it out, ``keep`` adds it as text in a column ``rejected``."""
    if on_error == "fail":
        rows = spark.read.option("sep", sep).option("nullValue", null).option("mode", "FAILFAST").schema(schema).csv(path)
    else:
        # parsed from lines, so that whether a row is as it should be can't depend on the columns
        # that a query asks for
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        options = {"sep": sep, "nullValue": null, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "rejected"}
        lines = spark.read.text(path).where("value <> ''")
        rows = lines.select(F.from_csv("value", f"{fields}, `rejected` string", options).alias("r")).select("r.*")
        if on_error == "drop":
            rows = rows.where("rejected IS NULL").drop("rejected")
        elif on_error != "keep":
            raise ValueError(f"on_error {on_error!r} is none of 'fail', 'drop', 'keep'")
    return rows if where is None else rows.where(where)


def read_edges(spark: SparkSession, path: str | list[str], weight: float | None = None) -> DataFrame:
    """Edges from lines of two whole numbers with tabs or spaces between; ``weight`` is added."""
    parts = F.split(F.trim("value"), "[\t ]+")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    edges = lines.select(parts[0].cast("long").alias("from_node"), parts[1].cast("long").alias("to_node"))
    return edges if weight is None else edges.withColumn("weight", F.lit(float(weight)))


def read_adjacency(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Edges from lines ``id:n1,n2,...``, a node and its neighbours; a comma may end the line, and a node
    without neighbours gives no edge."""
    parts = F.split(F.trim("value"), ":", 2)
    ends = F.filter(F.split(parts[1], ","), lambda x: F.trim(x) != "")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(parts[0].cast("long").alias("from_node"), F.explode(ends).alias("to")).select("from_node", F.trim("to").cast("long").alias("to_node"))


def read_nodes(spark: SparkSession, path: str | list[str], value: float | None = 0) -> DataFrame:
    """Nodes from lines of one whole number, with ``value`` (a rank to start from, say)."""
    nodes = spark.read.schema(NODES).csv(path)
    return nodes if value is None else nodes.withColumn("value", F.lit(value))


def write_values(df: DataFrame, path: str, sep: str = "\t", vector_sep: str = ",") -> None:
    """id and value as text; a value that is an array is joined by ``vector_sep``."""
    value = F.concat_ws(vector_sep, F.transform("value", lambda x: x.cast("string"))) if isinstance(df.schema["value"].dataType, T.ArrayType) else F.col("value")
    df.select("id", value.alias("value")).write.option("sep", sep).csv(path)


def ring(spark: SparkSession, n: int) -> DataFrame:
    """A directed ring of ``n`` nodes: id, value (10 id), to_node, weight (100 id)."""
    i = F.col("id")
    return spark.range(n).select("id", (i * 10).cast("double").alias("value"), ((i + 1) % n).alias("to_node"), (i * 100).cast("double").alias("weight"))

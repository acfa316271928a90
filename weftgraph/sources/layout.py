"""Edges stored for joins without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.lineage import forget, shared_dir, written
from weftgraph.plans.runs import current, delete_folder

#: A sender with more out-edges is dealt to several buckets.
HUB_EDGES = 1_000_000
#: With no more senders than this, how a round's join is done is left to Spark.
FEW_SENDERS = 100_000


def save_bucketed(edges: DataFrame, name: str, buckets: int, both: bool = False, path: str | None = None) -> None:
    """``edges`` as table ``name``, bucketed and sorted by from_node; with ``both`` also as
    ``name``_by_to, by to_node; in the warehouse, or in folders under ``path``.

    A join or aggregation on the bucketing column reads such a table without an exchange, and two
    tables of as many buckets meet without a sort.
    """
    for table, by in [(name, "from_node")] + [(f"{name}_by_to", "to_node")] * both:
        write = edges.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
        (write if path is None else write.option("path", f"{path}/{table}")).saveAsTable(table)


def analyse(spark: SparkSession, name: str) -> None:
    """Row counts and column statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


class BySender:
    """Edges in a bucketed table by sender, for loops that join them with a state each round.

    The edges are shuffled once, when the table is written to the shared folder; a round shuffles
    the state to their buckets and hashes it there, or broadcasts one that Spark knows to be small,
    so edges are neither dealt nor sorted again.
    A sender with over ``hub_edges`` out-edges is salted: its edges lie in several buckets, and its
    state goes to each of these.  Use as a context manager, or call :meth:`drop` when done.
    """

    def __init__(self, edges: DataFrame, buckets: int | None = None, hub_edges: int = HUB_EDGES):
        self.spark = edges.sparkSession
        # fewer buckets than a shuffle has partitions would have Spark deal the edges anew
        self.buckets = max(buckets or 0, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # written as they come first, since hubs are looked for before edges are dealt
        edges = plain = written(edges, "edges")
        degree = written(edges.groupBy("from_node").agg(F.count("*").alias("d")), "degrees")
        # a state of so few rows may be broadcast, if Spark finds it small
        self.few = degree.count() <= FEW_SENDERS
        # at most edges / hub_edges rows
        self.hubs = written(degree.where(F.col("d") > hub_edges).select("from_node", F.ceil(F.col("d") / F.lit(hub_edges)).cast("int").alias("salts")), "hubs")
        self.salted = not self.hubs.isEmpty()
        forget(degree)
        # without hubs there is no salt: as a constant it would drop out of the join, and with it the buckets
        self.keys = ["from_node", "salt"] if self.salted else ["from_node"]
        if self.salted:
            salts = F.coalesce("salts", F.lit(1))
            edges = edges.join(self.hubs, "from_node", "left").withColumn("salt", F.pmod(F.xxhash64("to_node"), salts).cast("int")).drop("salts")
        self.name = f"by_sender_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/weftgraph/{self.name}"
        run = current()
        if run is not None:
            run.check()
            run.folders.append(self.path)
        dealt = edges.repartition(self.buckets, *self.keys).write.option("path", self.path)
        dealt.bucketBy(self.buckets, *self.keys).sortBy("from_node").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        forget(plain)

    def meet(self, senders: DataFrame) -> DataFrame:
        """``senders`` (from_node and further columns, a row a sender) joined with their edges."""
        if self.salted:
            senders = senders.join(self.hubs, "from_node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        return self.table.join(senders if self.few else senders.hint("shuffle_hash"), self.keys).drop("salt")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_folder(self.spark, self.path)
        forget(self.hubs)

    def __enter__(self) -> BySender:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

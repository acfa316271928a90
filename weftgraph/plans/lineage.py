"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans.runs import current, delete_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and driver and
    executors are one process (tests, a laptop) is a temporary folder made and set for this
    context; on a cluster it would be a folder that others can't see, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Unlike a local checkpoint the rows outlive any executor; unlike an RDD
    checkpoint they stay columnar, so later reads prune columns.  Inside a
    :func:`weftgraph.plans.runs.run` that was cancelled nothing is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph/{label}-{uuid.uuid4().hex}"
    run = current()
    if run is not None:
        run.check()
        run.folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/weftgraph/" in name}:
        delete_folder(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let go of what finished queries have shuffled.

    Shuffle files stay until the driver's garbage collector finds that nothing refers to them,
    which may take long on a driver that does little; a job of many large stages asks for it.
    """
    spark.sparkContext._jvm.System.gc()

"""Runs that can be cancelled: jobs stop, driver loops end, and written tables go."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """A run was cancelled."""


class Run:
    """A handle on what a thread runs inside :func:`run`; any thread may cancel it.

    Spark's jobs of the run carry its tag.  Every driver loop writes a table a round, and each
    such write asks the run first, so a loop ends before its next round even if no job was under
    way when it was cancelled.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, f"run-{uuid.uuid4().hex}"
        self.folders: list[str] = []
        self._cancelled = threading.Event()

    @property
    def cancelled(self) -> bool:
        return self._cancelled.is_set()

    def cancel(self) -> None:
        self._cancelled.set()
        self.spark.interruptTag(self.tag)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled(self.tag)


_CURRENT: ContextVar[Run | None] = ContextVar("run", default=None)


def current() -> Run | None:
    return _CURRENT.get()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run(spark: SparkSession) -> Iterator[Run]:
    """A run of whatever the block does in this thread.  If it is cancelled, or ends in an error, the
    tables that it has written are deleted; after :meth:`Run.cancel` it ends in :class:`Cancelled`.
    Runs nest: an inner run's tables are its own, and go with it alone."""
    mine = Run(spark)
    token = _CURRENT.set(mine)
    spark.addTag(mine.tag)
    try:
        yield mine
        mine.check()
    except BaseException as e:
        spark.removeTag(mine.tag)
        for folder in mine.folders:
            delete_folder(spark, folder)
        if mine.cancelled and not isinstance(e, Cancelled):
            raise Cancelled(mine.tag) from e
        raise
    finally:
        spark.removeTag(mine.tag)
        _CURRENT.reset(token)

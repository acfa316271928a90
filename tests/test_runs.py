"""Cancelled runs: jobs stop, loops end, and no table is left."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.ranks import linerank
from weftgraph.plans import lineage, loops, runs
from weftgraph.plans.lineage import shared_dir, written
from weftgraph.plans.runs import Cancelled, run


def folders(spark):
    at = shared_dir(spark).removeprefix("file://") + "/weftgraph"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.from_edges(spark.range(60).selectExpr("id AS from_node", "(id * 7 + 1) % 60 AS to_node")).materialised()


def test_linerank_cancelled_in_its_third_round(spark, graph, monkeypatch):
    before, rounds = folders(spark), []
    plain = lineage.written

    def counting(df, label="t"):
        if label == "state":
            rounds.append(label)
            if len(rounds) == 3:
                runs.current().cancel()
        return plain(df, label)

    monkeypatch.setattr(loops, "written", counting)
    with pytest.raises(Cancelled), run(spark):
        linerank(graph, 10)
    assert len(rounds) == 3 and folders(spark) == before
    monkeypatch.undo()
    with run(spark):
        kept = linerank(graph, 3)
    assert kept.count() == 60 and folders(spark) > before  # what a run has finished stays


def test_a_job_under_way_is_stopped(spark):
    before, began = folders(spark), time.time()
    with pytest.raises(Cancelled), run(spark) as mine:
        threading.Timer(3, mine.cancel).start()
        slow = spark.range(4, numPartitions=4).select(F.expr("reduce(sequence(1, 40000000), 0L, (s, x) -> s + x % (id + 2))").alias("x"))
        written(slow, "slow")
    assert time.time() - began < 60 and folders(spark) == before
    assert spark.range(10).count() == 10


def test_errors_clean_up_and_runs_nest(spark):
    before = folders(spark)
    with run(spark):
        outer = written(spark.range(3), "outer")
        with pytest.raises(ZeroDivisionError), run(spark):
            written(spark.range(3), "inner")
            raise ZeroDivisionError
        assert outer.count() == 3
    left = folders(spark) - before
    assert len(left) == 1 and "outer" in next(iter(left)) and runs.current() is None


def test_cancelled_after_the_last_write(spark):
    with pytest.raises(Cancelled), run(spark) as mine:
        mine.cancel()
    assert mine.cancelled

"""Phases, partitions across batches, and functions that know their peers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.functions.aggregates import exact_gcd
from weftgraph.functions.phases import Phase, Rank, RunningFold, begins, gathered, in_phases, partitions_of, running_by_peers, with_analytic
from weftgraph.operators.degrees import neighbour_degrees


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_begins():
    a = pa.array([1, 1, None, None, 2, 2])
    b = pa.array([1.0, 1.0, 1.0, 1.0, float("nan"), float("nan")])
    assert begins([a, b], None).tolist() == [True, False, True, False, True, False]
    assert begins([a, b], [1, 1.0]).tolist()[0] is False and begins([a, b], [None, 1.0]).tolist()[0] is True
    assert begins([pa.array([float("nan"), None])], [float("nan")]).tolist() == [False, True]
    assert begins([pa.array([None], pa.int64())], [None]).tolist() == [False] and begins([pa.array([], pa.int64())], None).tolist() == []


def test_partitions_over_batches():
    rng = random.Random(1)
    for _ in range(200):
        keys = sorted(rng.randint(0, 4) for _ in range(rng.randint(0, 12)))
        rows = [(k, i) for i, k in enumerate(keys)]
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(0, 4)
            piece = rows[at : at + n]
            batches.append(pa.record_batch({"k": pa.array([r[0] for r in piece], pa.int64()), "v": pa.array([r[1] for r in piece], pa.int64())}))
            at += n
        read = rng.choice([0, 1, 99])  # pieces that a function looks at
        got = {}
        for part in partitions_of(iter(batches), ["k"]):
            assert part.key[0] not in got
            mine = []
            for j, piece in enumerate(part):
                if j >= read:
                    break
                mine += piece.column(1).to_pylist()
            got[part.key[0]] = mine
        assert list(got) == sorted(set(keys))
        if read == 99:
            assert got == {k: [i for q, i in rows if q == k] for k in set(keys)}
    whole = list(partitions_of(iter([pa.record_batch({"k": [1, 2]}), pa.record_batch({"k": [2]})]), []))
    assert len(whole) == 1 and whole[0].key == ()


def test_small_batches_are_gathered():
    many = [pa.record_batch({"a": pa.array([i] * (i % 3), pa.int64())}) for i in range(9000)]
    out = list(gathered(iter(many)))
    assert sum(b.num_rows for b in out) == 9000 and len(out) == 3
    assert [x for b in out for x in b.column(0).to_pylist()] == [i for i in range(9000) for _ in range(i % 3)]
    assert list(gathered(iter([]))) == [] == list(gathered(iter(many[:1])))


def test_prepass_and_two_phases(small_batches):
    def per_task(part):
        yield pa.record_batch({"k": pa.array([r % 3 for rows in part for r in rows.column(0).to_pylist()], pa.int64())})

    def count(part):
        yield pa.record_batch({"k": pa.array([part.key[0]], pa.int64()), "n": pa.array([sum(r.num_rows for r in part)], pa.int64())})

    def total(part):
        yield pa.record_batch({"n": pa.array([part.key[0]], pa.int64()), "ks": [",".join(str(k) for r in part for k in r.column(0).to_pylist())]})

    phases = [Phase(per_task, "k bigint"), Phase(count, "k bigint, n bigint", ("k",)), Phase(total, "n bigint, ks string", ("n",), ("k DESC",))]
    df = in_phases(small_batches.range(100, numPartitions=4), phases)
    assert sorted(map(tuple, df.collect())) == [(33, "2,1"), (34, "0")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 2  # one a phase, none for the prepass
    assert in_phases(small_batches.range(0), phases).count() == 0


def test_phases_that_do_not_fit_are_refused(spark):
    df = spark.range(3)
    for phases, says in (([], "no phases"), ([Phase(iter, "k bigint", ("x",))], "phase 1 .* by x"), ([Phase(iter, "k bigint"), Phase(iter, "k bigint", ("id",))], "phase 2"), ([Phase(iter, "k bigint", (), ("id",))], "prepass")):
        with pytest.raises(ValueError, match=says):
            in_phases(df, phases)


def test_neighbour_degrees(small_batches):
    rng = random.Random(2)
    edges = {(rng.randint(0, 15), rng.randint(0, 15)) for _ in range(60)} | {(99, i) for i in range(40)}
    d = {a: sum(x == a for x, _ in edges) for a, _ in edges}
    want = {}
    for a, b in edges:
        if b in d:
            want[d[a], d[b]] = want.get((d[a], d[b]), 0) + 1
    df = small_batches.createDataFrame([*edges, (None, 1), (1, None)], "from_node bigint, to_node bigint")
    assert {(r["degree"], r["neighbour_degree"]): r["pairs"] for r in neighbour_degrees(df).collect()} == want
    assert neighbour_degrees(df.limit(0)).count() == 0


ROWS = [(k, q, v) for k in (1, None, 2) for q, v in [(1, 60), (1, 90), (None, 7 * 30), (2, None), (3, 45), (3, 45), (3, -20), (4, 7)]]


def test_running_gcd_over_peers(small_batches):
    df = small_batches.createDataFrame(ROWS, "k int, q int, v bigint").repartition(3)
    got = running_by_peers(df, "g", "v", np.gcd, exact_gcd, ["k"], "q").collect()
    assert sorted(r["g"] for r in got if r["k"] == 2) == sorted([30, 30, 210, 30, 5, 5, 5, 1]) and len(got) == len(ROWS)
    assert {r["g"] for r in got if r["q"] == 3} == {5} and {r["g"] for r in got if r["q"] is None} == {210}
    alone = running_by_peers(df.where("v IS NULL"), "g", "v", np.gcd, exact_gcd, ["k"], "q").collect()
    assert [r["g"] for r in alone] == [None] * 3


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_ranks_against_windows(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.range(300).selectExpr("id", "IF(id % 11 = 0, NULL, id % 4) AS k", "(id * 7) % 13 AS q", "CAST(id AS STRING) AS extra")
    both = with_analytic(with_analytic(df, "place", "bigint", Rank, ["k"], ["q DESC"]), "dense", "bigint", lambda: Rank(dense=True), ["k"], ["q DESC"])
    want = df.selectExpr("*", "CAST(rank() OVER (PARTITION BY k ORDER BY q DESC) AS BIGINT) AS place", "CAST(dense_rank() OVER (PARTITION BY k ORDER BY q DESC) AS BIGINT) AS dense")
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError, match="one task"):
        with_analytic(df, "x", "bigint", Rank, [], ["q"])


def test_running_fold_in_order(small_batches):
    df = small_batches.createDataFrame([(1, i, v) for i, v in enumerate([None, 12, None, 18, 4, None])], "k int, i int, v bigint")
    got = with_analytic(df, "g", "bigint", lambda: RunningFold("v", np.gcd), ["k"], ["i"]).orderBy("i").collect()
    assert [r["g"] for r in got] == [None, 12, 12, 6, 2, 2]


def test_one_key_of_many_rows_is_streamed(spark):
    """The function sees pieces, never the whole of a key."""

    def sizes(part):
        n = [rows.num_rows for rows in part]
        yield pa.record_batch({"pieces": pa.array([len(n)], pa.int64()), "most": pa.array([max(n)], pa.int64()), "rows": pa.array([sum(n)], pa.int64())})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    row = in_phases(spark.range(400_000).select(F.lit(1).alias("k"), "id"), [Phase(sizes, "pieces bigint, most bigint, rows bigint", ("k",), ("id",))]).first()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert row["rows"] == 400_000 and row["most"] <= 5000 and row["pieces"] == 80

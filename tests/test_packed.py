"""Packed lists: round trips, skipping, and counts from them."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.functions.packed import BLOCK, Packed, common_counts, pack, pack_lists, packed_triangle_count, unpack_lists

LONG = st.integers(-(2**63), 2**63 - 1)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.sets(LONG, max_size=300), st.sets(st.integers(0, 600), max_size=400)))
def test_round_trip(ids):
    ids = np.array(sorted(ids), dtype=np.int64)
    p = Packed(pack(ids))
    assert p.n == len(ids) and (p.ids() == ids).all()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2000), max_size=700), st.sets(st.integers(0, 2000), max_size=700))
def test_common(a, b):
    x, y = (Packed(pack(np.array(sorted(s), dtype=np.int64))) for s in (a, b))
    assert sorted(a & b) == x.common(y).tolist() == y.common(x).tolist()


def test_blocks_that_do_not_meet_are_skipped():
    long = Packed(pack(np.arange(0, 1_000_000, 3)))
    short = Packed(pack(np.array([30, 31, 900_000])))
    assert short.common(long).tolist() == [30, 900_000]
    # the few ids are one block, which spans most of the list
    assert Packed(pack(np.array([900_000]))).common(long).tolist() == [900_000] and long.read <= 2 + -(-300_001 // BLOCK)
    near = Packed(pack(np.arange(999_000, 999_100)))
    far = Packed(pack(np.arange(0, 1_000_000, 3)))
    assert len(near.common(far)) == 34 and far.read <= 2
    assert len(pack(np.arange(10_000))) < 10_000 * 8 / 30  # steps of one take no bits
    assert Packed(pack(np.zeros(0, np.int64))).common(long).tolist() == []
    for bad in ([2, 1], [1, 1]):
        with pytest.raises(ValueError, match="rise strictly"):
            pack(np.array(bad))


@pytest.mark.parametrize(("chunk", "batch"), [(8192, 10_000), (10, 7), (1, 3)])
def test_lists_of_a_table(spark, chunk, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = [(k, v) for k in (1, 2, -5) for v in range(0, 40 * abs(k), 3)] + [(1, 3), (1, 3), (None, 1), (2, None)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(3)
    lists = pack_lists(df, "k", "v", chunk)
    found = lists.collect()
    assert all(r["n"] <= chunk and r["first"] <= r["last"] for r in found)
    back = sorted((r["k"], r["v"]) for r in unpack_lists(lists, "k", "v").collect())
    assert back == sorted({(k, v) for k, v in rows if k is not None and v is not None})
    of = {k: {v for q, v in back if q == k} for k in (1, 2, -5)}
    pairs = spark.createDataFrame([(a, b) for a in of for b in of] + [(1, 77)], "a bigint, b bigint")
    got = {(r["a"], r["b"]): r["n"] for r in common_counts(pairs, lists, "k").collect()}
    assert got == {(a, b): len(of[a] & of[b]) for a in of for b in of}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_triangles(spark):
    pairs = [(a, b) for a, b in itertools.combinations(range(20), 2) if (a * b) % 3 == 1 or a == 0]
    want = sum((a, b) in pairs and (a, c) in pairs and (b, c) in pairs for a, b, c in itertools.combinations(range(20), 3))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert packed_triangle_count(df).first()["triangles"] == want > 0
    assert packed_triangle_count(df.limit(0)).first()["triangles"] == 0

"""Table functions over whole batches: against brute force, in few rows, however batches are cut."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.functions import list_functions as L
from weftgraph.functions import table_functions as T
from weftgraph.plans.lineage import written

FAR = 1 << 62


def symmetric(pairs):
    pairs = list(pairs)
    return sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})


def neighbours(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    return out


def random_edges(ids, n, seed):
    draw = random.Random(seed)
    return symmetric((a, b) for a, b in (draw.sample(ids, 2) for _ in range(n)))


def cut(rows, schema, size):
    """``rows`` as batches of so many, each a slice of one batch."""
    whole = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    return [whole.slice(i, size) for i in range(0, max(1, whole.num_rows), size)]


def called(handler, batches, *more):
    out = []
    for b in batches:
        out += list(handler.eval(b, *(pa.array([m] * b.num_rows) for m in more)) or [])
    out += list(handler.terminate() if hasattr(handler, "terminate") else [])
    return [tuple(r.values()) for b in out for r in b.to_pylist()]


BLOCKS = pa.schema([("id", pa.int64()), ("edge", pa.int64()), ("side", pa.int32()), ("x", pa.int32()), ("y", pa.int32())])
WIRE = pa.schema([("id", pa.int64()), ("edge", pa.int64()), ("value", pa.int64()), ("width", pa.int8()), ("others", pa.binary())])


def sent(edges, size, blocks=1):
    """What the first nodes of ``edges`` send, with their neighbours in so many blocks."""
    rows = []
    for a, b in edges:
        of = b % blocks
        for t in range(blocks):
            rows.append((a, b, int(t < of), min(of, t), max(of, t)))
    rows.sort(key=lambda r: (r[0], r[3], r[4], r[2], r[1]))
    return called(L.SendLists(), cut(rows, BLOCKS, size))


def told(messages):
    """(id, other, sender) of messages."""
    out = []
    for node, sender, width, others in messages:
        sizes, found = L.decode(np.array([node]), np.array([width]), pa.array([others], pa.binary()))
        assert sizes.tolist() == [len(found)] and len(found) <= L.LIST
        out += [(node, o, sender) for o in found.tolist()]
    return sorted(out)


IDS = [list(range(30)), [-FAR, -FAR + 1, -7, 0, 3, 300, 70_000, 1 << 33, FAR, FAR + 1, *range(1000, 1010)]]


@pytest.mark.parametrize("ids", IDS)
@pytest.mark.parametrize(("size", "blocks"), [(1, 1), (7, 1), (1000, 1), (3, 2), (50, 3)])
def test_each_pair_of_neighbours_is_told_of_once(ids, size, blocks):
    edges = random_edges(ids, 120, size)
    want = sorted((b, a, s) for s, nb in neighbours(edges).items() for a, b in itertools.combinations(sorted(nb), 2))
    assert told(sent(edges, size, blocks)) == want
    assert told(sent(sorted(edges * 2), size, blocks)) == want  # repeated rows count once


def test_long_lists_are_cut():
    edges = [(5, 10 * i) for i in range(700)]
    messages = sent(edges, 200)
    assert len(told(messages)) == 700 * 699 // 2 and max(len(m[3]) for m in messages) <= L.LIST * 8


def triangles(edges):
    nb = neighbours(edges)
    return [t for t in itertools.combinations(sorted(nb), 3) if t[1] in nb[t[0]] and t[2] in nb[t[0]] & nb[t[1]]]


def closing(edges, size):
    """Rows of the second superstep, from edges that go from the smaller id on."""
    once = [(a, b) for a, b in edges if a < b]
    rows = [(b, a, None, None, None) for a, b in once] + [(m[0], None, *m[1:]) for m in sent(once, size)]
    return cut(sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0)), WIRE, size)


@pytest.mark.parametrize("ids", IDS)
@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_triangles_of_each_node(ids, size):
    edges = random_edges(ids, 90, size)
    corners = triangles(edges)
    of = collections.Counter(itertools.chain.from_iterable(corners))
    got = collections.Counter()
    for v, n in called(L.PernodeTrianglesOfLists(), closing(edges, size)):
        got[v] += n
    assert corners and got == of


def test_rows_out_of_order_are_refused():
    rows = [(2, 1, None, None, None), (1, 0, None, None, None)]
    with pytest.raises(ValueError, match="ordered by id"):
        called(L.PernodeTrianglesOfLists(), cut(rows, WIRE, 1))
    late = [(3, None, 9, 1, b"\x01"), (3, 1, None, None, None)]
    for size in (1, 2):
        with pytest.raises(ValueError, match="after a message"):
            called(L.PernodeTrianglesOfLists(), cut(late, WIRE, size))
    with pytest.raises(ValueError, match="ordered by id, x, y, side, edge"):
        called(L.SendLists(), cut([(1, 5, 0, 0, 0), (1, 4, 0, 0, 0), (2, 4, 0, 0, 0)], BLOCKS, 3))
    with pytest.raises(ValueError, match="must be a table"):
        list(L.SendLists().eval(pa.array([3])))


@pytest.fixture(scope="module")
def dense(spark):
    """All pairs of 40 nodes, and edges at random."""
    edges = symmetric([*itertools.combinations(range(40), 2), *random_edges(range(30, 120), 300, 5)])
    return edges, written(spark.createDataFrame(edges, "from_node bigint, to_node bigint"), "dense")


def forward(df):
    return df.where("from_node < to_node").selectExpr("from_node AS a", "to_node AS b")


def by_batches(df):
    """Python takes whole batches in every table function of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan


def test_pernode_triangles_go_by_lists(spark, dense):
    """a row for each edge and one for what is sent along it, not one a pair of neighbours."""
    edges, df = dense
    wire = written(T.closed_pairs(forward(df)), "wire")
    assert wire.count() < len(edges)
    found = T.pernode_triangles_in_sql(wire, 3)
    assert by_batches(found) and {r["id"]: r["triangles"] for r in found.collect()} == collections.Counter(itertools.chain.from_iterable(triangles(edges)))


def test_functions_over_rows_agree(spark, dense):
    """The functions that take a message a row give the same of the same graph."""
    edges, df = dense
    T.register(spark)
    send = "SELECT id, edge, value FROM pregel_send(TABLE({blocks}) PARTITION BY (id, x, y) ORDER BY (side, edge))"
    pairs = spark.sql(send, blocks=T.neighbour_blocks(forward(df).selectExpr("a AS id", "b AS edge"), 15))
    wire = written(pairs.unionByName(forward(df).selectExpr("a AS id", "b AS edge", "CAST(NULL AS DOUBLE) AS value")), "wire")
    call = "pregel_{}(TABLE({{wire}}) PARTITION BY (id % 2) ORDER BY (id, edge, value NULLS FIRST))"
    corners = triangles(edges)
    assert spark.sql(f"SELECT sum(triangles) AS n FROM {call.format('triangle')}", wire=wire).first()["n"] == len(corners)
    of = spark.sql(f"SELECT id, sum(triangles) AS n FROM {call.format('pernode_triangle')} GROUP BY id", wire=wire).collect()
    assert {r["id"]: r["n"] for r in of} == collections.Counter(itertools.chain.from_iterable(corners))
    told_of = spark.sql(send, blocks=T.neighbour_blocks(df.selectExpr("to_node AS id", "from_node AS edge"))).selectExpr("id", "edge", "1D AS value")
    nb = neighbours(edges)
    shared = {(a, b): len(nb[a] & nb[b]) for a, b in itertools.combinations(sorted(nb), 2)}
    got = spark.sql("SELECT * FROM pregel_overlap(TABLE({m}) PARTITION BY (id % 2) ORDER BY (id, edge), threshold => 4)", m=told_of).collect()
    assert {(r["n1"], r["n2"]): r["overlap"] for r in got} == {p: n for p, n in shared.items() if n >= 4}
    got = spark.sql("SELECT * FROM pregel_strong_overlap(TABLE({m}) PARTITION BY (edge % 2) ORDER BY (edge, id), threshold => 4)", m=told_of).collect()
    assert {r["id"]: r["partners"] for r in got} == collections.Counter(b for (_, b), n in shared.items() if n >= 4)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_triangles_over_batches(size):
    edges = random_edges(range(40), 150, size)
    assert called(L.TrianglesOfLists(), closing(edges, size)) == [(len(triangles(edges)),)]


def test_triangles_go_by_lists(spark, dense):
    """counted a batch at a time; the sender, which no count needs, is not shuffled."""
    edges, df = dense
    wire = written(T.closed_pairs(forward(df)), "wire")
    found = T.triangles_in_sql(wire, 3)
    assert by_batches(found) and found.first()["triangles"] == len(triangles(edges))
    assert T.triangles_in_sql(wire.withColumn("value", wire["value"] * 0), 3).first()["triangles"] == len(triangles(edges))


def test_triangles_over_tasks_without_rows(spark, dense):
    """tasks that no partition is dealt to, as where Spark doesn't join small ones."""
    edges, df = dense
    wire = written(T.closed_pairs(forward(df)), "wire")
    kept = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        assert T.triangles_in_sql(wire, 3).first()["triangles"] == len(triangles(edges))
        assert T.triangles_in_sql(wire.where("id < 0"), 3).first()["triangles"] == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


TIES = pa.schema([("id", pa.int64()), ("edge", pa.int64()), ("value", pa.float64())])


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_weak_ties_over_batches(size):
    edges = random_edges(range(40), 150, size)
    nb, of = neighbours(edges), collections.Counter(itertools.chain.from_iterable(triangles(edges)))
    rows = [(a, b, None) for a, b in edges] + [(v, None, float(n)) for v, n in of.items() for n in (n - 1, 1)]
    rows = [(None, 4, None), (None, None, 2.0), *sorted(rows, key=lambda r: r[0])]
    for least in (0, 9):
        ties = {v: len(b) * (len(b) - 1) // 2 - of[v] for v, b in nb.items()}
        assert dict(called(L.WeakTiesOfBatches(), cut(rows, TIES, size), least)) == {v: n for v, n in ties.items() if n >= least}
    with pytest.raises(ValueError, match="ordered by id"):
        called(L.WeakTiesOfBatches(), cut(rows[2:][::-1], TIES, size), 1)


def test_weak_ties_go_by_batches(spark, dense):
    """edges are counted a batch at a time."""
    edges, df = dense
    nb, of = neighbours(edges), collections.Counter(itertools.chain.from_iterable(triangles(edges)))
    found = T.weak_ties_in_sql(df, T.pernode_triangles_in_sql(T.closed_pairs(forward(df)), 3), 20, 3)
    ties = {v: float(len(b) * (len(b) - 1) // 2 - of[v]) for v, b in nb.items()}
    assert by_batches(found) and {r["id"]: r["ties"] for r in found.collect()} == {v: n for v, n in ties.items() if n >= 20}


MESSAGES = pa.schema([("id", pa.int64()), ("width", pa.int8()), ("others", pa.binary())])


def overlaps(edges):
    nb = neighbours(edges)
    return {(a, b): len(nb[a] & nb[b]) for a, b in itertools.combinations(sorted(nb), 2)}


def heard(edges, size, blocks=1):
    return cut(sorted((m[0], m[2], m[3]) for m in sent(edges, 50, blocks)), MESSAGES, size)


@pytest.mark.parametrize("ids", IDS)
@pytest.mark.parametrize(("size", "least"), [(1, 1), (2, 3), (7, 2), (1000, 3)])
def test_overlap_over_batches(ids, size, least, monkeypatch):
    monkeypatch.setattr(L, "BATCH", 10)  # so that what is kept of a node is added up now and then
    edges = random_edges(ids, 120, size)
    want = sorted((a, b, n) for (a, b), n in overlaps(edges).items() if n >= least)
    assert sorted(called(L.OverlapOfLists(), heard(edges, size, 2), least)) == want


def test_overlap_goes_by_lists(spark, dense):
    """a receiver tells each sender once, not once a pair."""
    edges, df = dense
    messages = written(T.overlap_messages(df), "messages")
    assert messages.count() <= len(edges)
    found = T.strong_overlap_in_sql(messages, 4, partitions=3)
    assert by_batches(found) and {(r["n1"], r["n2"]): r["overlap"] for r in found.collect()} == {p: n for p, n in overlaps(edges).items() if n >= 4}


@pytest.mark.parametrize("ids", IDS)
@pytest.mark.parametrize(("size", "least"), [(1, 1), (2, 3), (1000, 3)])
def test_partners_over_batches(ids, size, least):
    edges = random_edges(ids, 120, size)
    want = collections.Counter(b for (_, b), n in overlaps(edges).items() if n >= least)
    assert dict(called(L.StrongOverlapOfLists(), heard(edges, size), least)) == want


def test_partners_of_hubs_go_by_lists(spark, dense):
    """counted a batch at a time, from small batches and blocks as well."""
    edges, df = dense
    want = collections.Counter(b for (_, b), n in overlaps(edges).items() if n >= 4)
    for block, records in ((10_000, 10_000), (7, 5)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            messages = written(T.overlap_messages(df, block), "messages")
            found = T.strong_overlap_in_sql(messages, 4, True, 3)
            assert by_batches(found) and {r["id"]: r["partners"] for r in found.collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

"""Embedding operators against brute force, with every kind of unusable vector."""

import math

import numpy as np
import pytest

from weftgraph.llm.neardup import cells_of, embedding_near_duplicates, links_in_blocks, spherical_kmeans
from weftgraph.llm.topk import exact_top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, id string, unit string, cell int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(600):
        v = rng.normal(size=8)
        if i % 3 == 0:
            v = np.ones(8) + 0.35 * rng.normal(size=8)
        if i % 5 == 0:
            v = np.arange(8.0)
        out.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    bad = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")]]
    out += [(700 + i, v, 1) for i, v in enumerate(bad)]
    out += [(710, [1.0] * 8, None), (711, [1.0] * 8, None), (712, [2.0] * 8, 1), (713, [1.0] * 8, 1), (720, [1.0] * 3, 1)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None, 2) for r in rows], SCHEMA).repartition(5)


def usable(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicates(table, rows):
    able = [(i, np.array(v, float), k) for i, v, k in rows if usable(v) and k is not None and np.linalg.norm(v) > 0]
    ids, x, k = np.array([a[0] for a in able]), np.array([a[1] / np.linalg.norm(a[1]) for a in able]), np.array([a[2] for a in able])
    hit = (x @ x.T >= 0.93 - 1e-12) & (k[:, None] == k[None])
    np.fill_diagonal(hit, False)
    low = ids.copy()
    while True:
        new = np.array([min([low[i], *low[hit[i]]]) for i in range(len(ids))])
        if (new == low).all():
            break
        low = new
    want = {i: (0, i) for i, _, _ in rows} | {int(i): (int(n), int(c)) for i, n, c in zip(ids, hit.sum(axis=1), low, strict=True)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_near_duplicates(table).collect()}
    assert got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in embedding_near_duplicates(table).collect())


def test_near_duplicates_of_odd_tables(spark, table):
    assert embedding_near_duplicates(table.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [2.0, 4.0], 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted((str(r["vec_id"]), r["component_id"], r["kept"]) for r in embedding_near_duplicates(odd).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("4", 3, False), ("None", None, False)]


def test_cells_lose_no_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 6))
    x[400:] = x[:400] + 0.15 * rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = spherical_kmeans(x, 12)
    row, cell, home = cells_of(x, centres, 0.93)
    assert home.sum() == len(x)
    count = np.zeros(len(x), int)
    for c in range(len(centres)):
        mine, all_ = row[(cell == c) & home], row[cell == c]
        n, _ = links_in_blocks(x[mine], mine, x[all_], all_, np.ones(len(all_), int), 0.93)
        count[mine] += n
    full = x @ x.T >= 0.93
    np.fill_diagonal(full, False)
    assert (count == full.sum(axis=1)).all()


def test_top_k(spark, table, rows):
    able = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows if usable(v)]
    want = []
    for q, w in able:
        if q % 50 == 0:
            best = sorted((-int(w @ u), i) for i, u in able if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_top_k(table).collect())
    assert got == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (None, [9.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in exact_top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert exact_top_k(table.limit(0)).count() == 0


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=2).collect())
    assert got == [(0, 1, 0, 65536), (0, 1, 0, 65536), (0, 2, 1, 65536), (0, 2, 1, 65536)]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_near_duplicates_of_mixed_widths(spark, rows, parts):
    """Each width is compared as if it were alone, wherever its rows are, and no row is lost."""
    schema = "vec_id bigint, embedding array<double>, label int"
    narrow = [(i, v, k) for i, v, k in rows if usable(v)]
    wide = [(10_000 + i, [*v, 0.5], k) for i, v, k in narrow[:50]] + [(20_000, [1.0] * 30, 1)]
    got = embedding_near_duplicates(spark.createDataFrame(narrow + wide, schema).coalesce(1).repartition(parts, "label") if parts > 1 else spark.createDataFrame(narrow + wide, schema).coalesce(1))
    alone = [r for part in (narrow, wide[:50], wide[50:]) for r in embedding_near_duplicates(spark.createDataFrame(part, schema)).collect()]
    assert sorted(map(str, got.collect())) == sorted(map(str, alone)) and len(alone) == len(narrow) + len(wide)
    assert sum(r["n_links"] > 0 for r in alone if r["vec_id"] >= 10_000) > 5 and sum(r["n_links"] > 0 for r in alone if r["vec_id"] < 10_000) > 50


def test_near_duplicates_beside_a_batch_of_wider_vectors(spark, rows):
    schema = "vec_id bigint, embedding array<double>, label int"
    narrow = [(i, v, k) for i, v, k in rows if usable(v)]
    one = spark.createDataFrame([(20_000, [1.0] * 9, 1)], schema).coalesce(1)
    got = embedding_near_duplicates(spark.createDataFrame(narrow, schema).coalesce(1).union(one)).collect()
    assert len(got) == len(narrow) + 1 and sum(r["n_links"] > 0 for r in got) > 50


def test_top_k_where_short_vectors_come_before_long_ones(spark, monkeypatch):
    """A task may read a file of short vectors and then one of longer ones, in one batch."""
    from weftgraph.llm import topk

    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 4)) * np.where(np.arange(6000) < 4000, 0.01, 1.0)[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    plain = topk.written
    turned = lambda df, label="t": plain(df.orderBy("length").coalesce(1) if label == "ordered" else df, label)
    monkeypatch.setattr(topk, "written", turned)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in exact_top_k(df, every=500).collect())
    w = np.floor(256 * x).astype(int)
    want = [(q, r, i, -s) for q in range(0, 6000, 500) for r, (s, i) in enumerate(sorted((-int(w[q] @ w[i]), i) for i in range(6000) if i != q)[:5], 1)]
    assert got == want


def test_top_k_of_huge_components(spark):
    rows = [(0, [3e6, 0.0]), (1, [3e6, 1.0]), (2, [-2e6, 5.0]), (3, [4e4, 0.5])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=50, scale=256).collect()
    w = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(w[0], w[i])), i) for i in (1, 2, 3)))
    assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    for bad in ([3e9], [4e13], [1e300]):
        df = spark.createDataFrame([(0, bad), (1, bad)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64 bits"):
            exact_top_k(df).collect()
    near = [(0, [3e7, 3e7]), (1, [-3e7, 3e7]), (2, [1e7, -1e7])]  # parts near the edge, sums within
    got = exact_top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>"), k=2).collect()
    assert sorted((r["vec_id"], r["score"]) for r in got) == [(1, 0), (2, 0)]


def test_top_k_of_a_huge_score_outside_the_result(spark):
    rows = [(0, [4e13, 0.0]), (1, [-4e13, 0.0])] + [(i, [i / 100, 1.0]) for i in range(2, 15)]
    got = sorted((r["rank"], r["vec_id"]) for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect())
    assert got == list(enumerate([14, 13, 12, 11, 10], 1))
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        exact_top_k(few).collect()


@pytest.mark.parametrize("parts", [1, 4])
def test_near_duplicates_of_repeated_ids_with_unlike_vectors(spark, parts):
    """A row links with all others of its label that are near, whatever their ids."""
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.02], 1)]
    got = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(parts)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 1, True), (1, 3, 1, True), (2, 0, 1, False), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True)]

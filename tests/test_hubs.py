"""Cliques, overlap, factorisation and gcds of graphs with hubs, against plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.functions.factorisation import factors_of, is_prime, power_text, prime_exponents, small_primes, smallest_factors
from weftgraph.graph import Graph
from weftgraph.operators import factors, neighbourhoods
from weftgraph.operators.neighbourhoods import CliqueSearch, maximal_cliques, pair_rows, peeled, rare_receivers, sender_pairs, strong_overlap


def graph(spark, pairs, both=True):
    rows = {(a, b) for a, b in pairs} | ({(b, a) for a, b in pairs} if both else set())
    return Graph.from_edges(spark.createDataFrame(sorted(rows), "from_node bigint, to_node bigint"))


def plain_cliques(pairs):
    nb = {}
    for a, b in pairs:
        if a != b:
            nb.setdefault(a, set()).add(b)
            nb.setdefault(b, set()).add(a)
    found = Counter()

    def grow(r, p, x):
        if not p and not x and len(r) >= 3:
            found[max(r)] += 1
        for v in sorted(p):
            grow(r | {v}, p & nb[v], x & nb[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(nb), set())
    return dict(found)


def cliques(g):
    return {r["id"]: r["cliques"] for r in maximal_cliques(g).collect()}


@pytest.mark.parametrize(("seed", "n", "p"), [(1, 14, 0.5), (2, 25, 0.3), (3, 10, 0.9), (4, 40, 0.1)])
def test_cliques_of_random_graphs(spark, seed, n, p):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), n)
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if rng.random() < p]
    hub = rng.choice(ids)
    pairs += [(hub, v) for v in ids if v != hub] + [(ids[0], ids[0])]
    assert cliques(graph(spark, pairs)) == plain_cliques(pairs)


def test_cliques_of_a_hub(spark):
    """A hub of 20,000 edges, whose leaves are a ring: as many triangles, found at the leaves."""
    n = 20_000
    ring = spark.range(1, n + 1).selectExpr("id AS from_node", "id % 20000 + 1 AS to_node")
    spokes = spark.range(1, n + 1).selectExpr("0L AS from_node", "id AS to_node")
    one = ring.union(spokes)
    g = Graph.from_edges(one.union(one.selectExpr("to_node", "from_node")))
    got = cliques(g)
    assert sum(got.values()) == n and got[n] == 2 and got[2] == 1 and 0 not in got
    levels = {r["id"]: r["level"] for r in peeled(g.edges).collect()}
    assert len(levels) == n + 1 and levels[0] == max(levels.values()) <= 1


def test_peeling_covers_every_node(spark):
    star = graph(spark, [(0, i) for i in range(1, 30)] + [(50, 51)])
    assert {r["id"] for r in peeled(star.edges).collect()} == {*range(30), 50, 51}
    assert peeled(star.edges.limit(0)).count() == 0 and cliques(star) == {}


def test_peeling_in_several_rounds(spark):
    """Leaves, then what they hang on, then a dense core."""
    core = list(range(10))
    pairs = list(itertools.combinations(core, 2)) + [(100 + i, c) for i in range(100) for c in core] + [(1000 + 20 * i + k, 100 + i) for i in range(100) for k in range(20)]
    g = graph(spark, pairs)
    levels = {r["id"]: r["level"] for r in peeled(g.edges).collect()}
    assert {levels[1000], levels[100], levels[0]} == {0, 1, 2} and len(levels) == 2110
    assert cliques(g) == {100 + i: 1 for i in range(100)}


def test_earlier_nodes_rule_cliques_out():
    assert CliqueSearch(1, [(2, 3)]).run() == {3: 1}
    s = CliqueSearch(1, [(2, 3), (3, 4)])
    s.bar([2, 3])
    s.bar([3])  # a single later node rules nothing out
    s.bar([3, 9])
    assert s.run() == {4: 1} and len(s.barred) == 1


@pytest.mark.parametrize(("least", "block"), [(1, 1000), (2, 3), (3, 1000), (4, 2), (8, 5)])
def test_overlap_by_either_way(spark, least, block):
    rng = random.Random(least)
    pairs = {(rng.randint(0, 25), rng.randint(100, 130)) for _ in range(300)} | {(i, 999) for i in range(26)}
    of = {}
    for a, b in pairs:
        of.setdefault(a, set()).add(b)
    want = {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2) if len(of[a] & of[b]) >= least}
    df = spark.createDataFrame([*pairs, (0, 999)], "from_node bigint, to_node bigint")  # one edge twice
    g = Graph(df.selectExpr("from_node AS id").distinct(), df)
    for prefix in (True, False, None):
        got = strong_overlap(g, least, strict=False, block=block, prefix=prefix)
        assert {(r["n1"], r["n2"]): r["overlap"] for r in got.collect()} == want
    assert {(r["n1"], r["n2"]) for r in strong_overlap(g, least).collect()} == {p for p, n in want.items() if n > least}


def test_hub_receivers_are_in_few_prefixes(spark):
    """A thousand senders of one hub, each with three receivers of its own and of its neighbour's."""
    rows = spark.range(1000).selectExpr("id AS from_node", "explode(array(-1L, id DIV 2 * 10, id DIV 2 * 10 + 1, id DIV 2 * 10 + 2)) AS to_node")
    marked = rare_receivers(rows, 3)
    assert pair_rows(rows) == 1000 * 999 // 2 + 3 * 500 and pair_rows(marked.where("prefix")) == 2 * 500
    assert sender_pairs(rows, 100).count() == pair_rows(rows)
    got = strong_overlap(Graph(rows.selectExpr("from_node AS id"), rows), 3, strict=False)
    assert {(r["n1"], r["n2"], r["overlap"]) for r in got.collect()} == {(i, i + 1, 4) for i in range(0, 1000, 2)}
    assert sender_pairs(rows.limit(0)).count() == 0 == pair_rows(rows.limit(0))


@pytest.mark.parametrize("batch", [2, 10_000])
def test_sgd_streams_what_an_item_hears(spark, batch):
    rng = random.Random(7)
    ratings = [(u, 1000 + i, float(rng.randint(1, 5))) for u in range(40) for i in range(4) if i == 0 or rng.random() < 0.4]
    vec = {v: [1.0, 1.0] for u, i, _ in ratings for v in (u, i)}
    for _ in range(3):
        new = {}
        for v in vec:
            x = vec[v]
            for s, r in sorted([(i, r) for u, i, r in ratings if u == v] + [(u, r) for u, i, r in ratings if i == v]):
                err = min(max(sum(a * b for a, b in zip(x, vec[s], strict=True)), 1.0), 5.0) - r
                x = [a - 0.005 * (0.01 * a + err * b) for a, b in zip(x, vec[s], strict=True)]
            new[v] = x
        vec = new
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r["id"]: r["vec"] for r in factors.factorise(spark.createDataFrame(ratings, "user bigint, item bigint, rating double"), updates=3).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(vec) and all(got[v] == pytest.approx(vec[v], rel=1e-12) for v in vec)


def test_prime_exponents(spark):
    numbers = [1, 2, 12, 97, 2**40, 2**62, 65537**2, 65537 * 65539, 4294967291 * 2, 3**30, 9223372036854775783, 2147483647 * 4294967291, 600851475143]
    i, p, e = factors_of(np.array(numbers))
    for k, n in enumerate(numbers):
        assert math.prod(int(q) ** int(x) for j, q, x in zip(i, p, e, strict=True) if j == k) == n
    assert all(is_prime(int(q)) for q in p)
    assert smallest_factors(30).tolist() == [0, 1] + [min(q for q in range(2, n + 1) if n % q == 0) for n in range(2, 31)]
    assert small_primes(30).tolist() == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    df = spark.createDataFrame([(n,) for n in numbers] * 2 + [(None,)], "n bigint")
    rows = prime_exponents(df, "n")
    assert rows.count() == len(p)
    assert {r["id"]: r["text"] for r in power_text(rows, "id", "text").collect()} == {n: str(n) for n in numbers if n > 1}
    with pytest.raises(Exception, match="no prime exponents"):
        prime_exponents(spark.range(3)).collect()


def test_cliques_gcd_of_random_graphs_and_a_hub(spark):
    rng = random.Random(5)
    pairs = {(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(250)} | {(1, i) for i in range(2, 60)} | {(30, 2**40), (2**40, 3)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want = {}
    for u, to in out.items():
        above = [v for v in to if v > u and v in out]
        if above:
            g = math.gcd(math.prod(above), *[v * math.prod(out[v]) for v in above])
            if g != u:
                want[u] = str(g)
    got = neighbourhoods.cliques_gcd(graph(spark, pairs, both=False))
    assert {r["from_node"]: r["gcd"] for r in got.collect()} == want
    assert neighbourhoods.cliques_gcd(graph(spark, [(1, 2)], both=False).reversed()).count() == 0

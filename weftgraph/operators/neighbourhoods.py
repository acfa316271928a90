"""Triangles, strong overlap, weak ties and cliques."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.factorisation import power_text, prime_exponents
from weftgraph.functions.phases import Partition, Phase, in_phases
from weftgraph.graph import Graph
from weftgraph.plans.lineage import forget, written

#: Senders of a receiver that meet others at a time.
BLOCK = 5_000


def ranked_edges(graph: Graph) -> DataFrame:
    """(a, b): each undirected edge once, from the end of lower degree to the other (ties by id),
    so that no node has more than about sqrt(2E) such edges and wedges stay few."""
    degree = graph.edges.where("from_node <> to_node").groupBy(F.col("from_node").alias("id")).agg(F.count("*").alias("d"))
    once = graph.edges.where("from_node < to_node").select("from_node", "to_node").distinct()
    both = once.join(degree.select(F.col("id").alias("from_node"), F.col("d").alias("d1")), "from_node", "left").join(degree.select(F.col("id").alias("to_node"), F.col("d").alias("d2")), "to_node", "left")
    forward = F.struct(F.coalesce("d1", F.lit(0)), "from_node") < F.struct(F.coalesce("d2", F.lit(0)), "to_node")
    return both.select(F.when(forward, F.col("from_node")).otherwise(F.col("to_node")).alias("a"), F.when(forward, F.col("to_node")).otherwise(F.col("from_node")).alias("b"))


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c): each triangle of a symmetric graph once."""
    e = ranked_edges(graph)
    wedge = e.alias("x").join(e.alias("y"), F.col("x.a") == F.col("y.a")).where(F.col("x.b") < F.col("y.b")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    close = e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    return wedge.join(close, ["b", "c"]).select("a", "b", "c")


def triangle_count(graph: Graph) -> DataFrame:
    return triangles(graph).agg(F.count("*").alias("triangles"))


def triangles_per_node(graph: Graph, include_zero: bool = False) -> DataFrame:
    """(id, triangles); nodes in none are absent unless asked for."""
    n = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").cast("double").alias("triangles"))
    if not include_zero:
        return n
    return graph.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("triangles", F.lit(0.0)).alias("triangles"))


def sender_pairs(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(n1, n2), n1 < n2: each two senders of each receiver, from (from_node, to_node) without repeats.

    A receiver's senders are cut into blocks of about ``block``, and each two blocks meet on a key
    of their own, so that the pairs of a hub are spread over many tasks.
    """
    blocks = edges.groupBy("to_node").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 0")
    of = edges.join(blocks, "to_node").withColumn("b", F.pmod(F.xxhash64("from_node"), F.col("blocks")).cast("int"))
    first = of.select("to_node", F.col("from_node").alias("p"), F.col("b").alias("x"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("y"))
    second = of.select("to_node", F.col("from_node").alias("q"), F.col("b").alias("y"), F.explode(F.sequence(F.lit(0), "b")).alias("x"))
    met = first.join(second, ["to_node", "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("n1"), F.greatest("p", "q").alias("n2"))


def rare_receivers(edges: DataFrame, least: int) -> DataFrame:
    """(from_node, to_node, prefix): ``edges`` with whether the receiver is among the sender's rarest.

    Receivers are ordered by how many send to them, the fewest first, alike for all senders.  Two
    senders that share ``least`` receivers share one that is, for both, among all but their last
    ``least`` - 1: that is the prefix, and hubs among receivers are seldom in any.
    """
    n = edges.groupBy("to_node").agg(F.count("*").alias("n"))
    order = Window.partitionBy("from_node").orderBy("n", "to_node")
    size = F.count("*").over(Window.partitionBy("from_node"))
    return edges.join(n, "to_node").select("from_node", "to_node", (F.row_number().over(order) <= size - (least - 1)).alias("prefix"))


def pair_rows(edges: DataFrame) -> int:
    """How many rows :func:`sender_pairs` gives."""
    n = F.col("n").cast("decimal(38,0)")
    return int(edges.groupBy("to_node").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1))).first()[0] or 0) // 2


def strong_overlap(graph: Graph, threshold: int = 100, strict: bool = True, block: int = BLOCK, prefix: bool | None = None) -> DataFrame:
    """(n1, n2, overlap): pairs n1 < n2 with more than ``threshold`` common out-neighbours (as
    many or more unless ``strict``); repeated edges count once.

    A node whose out-degree is below the count asked for can be in no such pair, so its edges go
    first.  Then pairs are made either at every receiver, or only at receivers in the prefixes of
    both (:func:`rare_receivers`), where each pair found looks up the few receivers beyond its
    prefixes; unless ``prefix`` says which, the way with fewer rows, as counted, is taken.  Both
    give all pairs.
    """
    least = max(1, threshold + 1 if strict else threshold)
    e = graph.edges.select("from_node", "to_node").distinct()
    if least > 1:
        able = e.groupBy("from_node").agg(F.count("*").alias("d")).where(F.col("d") >= least).select("from_node")
        e = e.join(able, "from_node", "left_semi")
    e = written(e, "senders")
    if prefix is None and least == 1:
        prefix = False  # every receiver is in the prefix
    if prefix is not False:
        marked = written(rare_receivers(e, least), "marked")
        rare = marked.where("prefix").select("from_node", "to_node")
        if prefix is None:
            prefix = pair_rows(rare) * (2 * least - 1) < pair_rows(e)
    if not prefix:
        counted = sender_pairs(e, block).groupBy("n1", "n2").agg(F.count("*").alias("overlap"))
        return counted.where(F.col("overlap") >= least)
    found = written(sender_pairs(rare, block).groupBy("n1", "n2").agg(F.count("*").alias("n")), "found")
    beyond = marked.where("NOT prefix").select(F.col("from_node").alias("s"), "to_node")
    sent = lambda df, n: df.select(F.col("from_node").alias(n), "to_node")
    one = found.join(beyond, F.col("n1") == F.col("s")).select("n1", "n2", "to_node").join(sent(e, "n2"), ["n2", "to_node"], "left_semi")
    two = found.join(beyond, F.col("n2") == F.col("s")).select("n1", "n2", "to_node").join(sent(rare, "n1"), ["n1", "to_node"], "left_semi")
    more = one.select("n1", "n2", F.lit(1).cast("bigint").alias("n")).unionByName(two.select("n1", "n2", F.lit(1).cast("bigint").alias("n")))
    counted = found.unionByName(more).groupBy("n1", "n2").agg(F.sum("n").alias("overlap"))
    return counted.where(F.col("overlap") >= least)


def overlap_per_node(graph: Graph, threshold: int = 100) -> DataFrame:
    """(id, partners): how many smaller nodes share at least ``threshold`` neighbours with it."""
    return strong_overlap(graph, threshold, strict=False).groupBy(F.col("n2").alias("id")).agg(F.count("*").alias("partners"))


def weak_ties(graph: Graph, threshold: int = 1000, strict: bool = True) -> DataFrame:
    """(id, ties): pairs of a node's neighbours that are not neighbours of each other, where more
    than ``threshold`` (as many or more unless ``strict``).

    On a simple symmetric graph that is C(degree, 2) less the node's triangles, so no open wedge
    is ever built; the graph's loops and repeated edges are left out first.
    """
    simple = Graph(graph.nodes, graph.edges.where("from_node <> to_node").select("from_node", "to_node").distinct())
    d = simple.out_degrees()
    least = F.col("degree") * (F.col("degree") - 1) / 2
    able = d.where(least > threshold if strict else least >= threshold)
    t = triangles_per_node(simple)
    ties = able.join(t, "id", "left").select("id", (least - F.coalesce("triangles", F.lit(0.0))).alias("ties"))
    return ties.where(F.col("ties") > threshold if strict else F.col("ties") >= threshold)


def cliques_gcd(graph: Graph) -> DataFrame:
    """(from_node, gcd): for each node the gcd of the product of its larger neighbours with the
    gcd, over these, of neighbour times product of the neighbour's neighbours; where it differs
    from the node.  A heuristic on ids as factors.  Larger neighbours without neighbours are left
    out.  Results are exact (decimal text); ids must be positive.

    Numbers are held as prime exponents, so a product is a sum and a gcd a minimum, and no number
    longer than an id is made before the result.  A prime of a node's gcd divides what each of its
    larger neighbours stands for, so only the primes of the one with the fewest are looked up at
    the others.
    """
    e = written(graph.edges.select(F.col("from_node").cast("bigint"), F.col("to_node").cast("bigint")).where("from_node IS NOT NULL AND to_node IS NOT NULL"), "edges")
    factors = written(prime_exponents(e, "to_node"), "factors")
    above = e.where("from_node < to_node").distinct().join(e.select(F.col("from_node").alias("to_node")).distinct(), "to_node", "left_semi")
    above = written(above.select("from_node", "to_node"), "above")
    # of v times the product of v's neighbours, for each v that is a larger neighbour
    v = above.select(F.col("to_node").alias("v")).distinct()
    products = e.join(v, F.col("from_node") == F.col("v")).join(factors, F.col("to_node") == F.col("id")).select("v", "prime", "exponent")
    own_factors = v.join(factors, F.col("v") == F.col("id")).select("v", "prime", "exponent")
    stands_for = written(products.unionByName(own_factors).groupBy("v", "prime").agg(F.sum("exponent").alias("exponent")), "powers")
    size = stands_for.groupBy("v").agg(F.count("*").alias("primes"))
    fewest = above.join(size, F.col("to_node") == F.col("v"), "left").select("from_node", F.struct(F.coalesce("primes", F.lit(0)).alias("primes"), "to_node").alias("s"))
    pivots = written(fewest.groupBy("from_node").agg(F.min("s").alias("s"), F.count("*").alias("n")).select("from_node", F.col("s.to_node").alias("pivot"), "n"), "pivots")
    able = written(pivots.join(stands_for, F.col("pivot") == F.col("v")).select("from_node", "n", "prime"), "able")
    asked = able.join(above, "from_node").select("from_node", "n", "prime", F.col("to_node").alias("v"))
    shared = asked.join(stands_for, ["v", "prime"]).groupBy("from_node", "n", "prime").agg(F.count("*").alias("k"), F.min("exponent").alias("shared")).where("k = n")
    factored = above.join(factors, F.col("to_node") == F.col("id")).select("from_node", "prime", "exponent")
    own = factored.join(able.select("from_node", "prime"), ["from_node", "prime"], "left_semi").groupBy("from_node", "prime").agg(F.sum("exponent").alias("own"))
    both = own.join(shared, ["from_node", "prime"]).select("from_node", "prime", F.least("own", "shared").alias("exponent"))
    texts = power_text(both, "from_node", "gcd")
    all_nodes = pivots.select("from_node").join(texts, "from_node", "left").select("from_node", F.coalesce("gcd", F.lit("1")).alias("gcd"))
    return all_nodes.where(F.col("gcd") != F.col("from_node").cast("string"))


def peeled(edges: DataFrame) -> DataFrame:
    """(id, level): each node of a simple symmetric graph with the round in which it is taken out.

    A round takes out all nodes with at most twice the average degree of what is left, so there
    are at most about log2(nodes) rounds, and a node has few neighbours of its own level or later:
    some four times the densest part's edges a node, however large its degree.
    """
    rest, levels, level = edges, [], 0
    while True:
        degrees = written(rest.groupBy(F.col("from_node").alias("id")).agg(F.count("*").alias("d")), "degrees")
        n, total = degrees.agg(F.count("*"), F.sum("d")).first()
        if not n:
            break
        limit = 2 * total / n
        stays = degrees.where(F.col("d") > limit).select("id")
        left = rest.join(stays.withColumnRenamed("id", "from_node"), "from_node", "left_semi").join(stays.withColumnRenamed("id", "to_node"), "to_node", "left_semi")
        rest, old = written(left.select("from_node", "to_node"), "rest"), rest
        # a node all of whose neighbours went has no edge left, and would be lost
        on = rest.select(F.col("from_node").alias("id")).distinct()
        levels.append(written(degrees.select("id").join(on, "id", "left_anti").withColumn("level", F.lit(level)), "level"))
        forget(degrees)
        if level:
            forget(old)
        level += 1
    if level:
        forget(rest)
    if not levels:
        return edges.select(F.col("from_node").alias("id"), F.lit(0).alias("level")).limit(0)
    return functools.reduce(DataFrame.unionAll, levels)


class CliqueSearch:
    """Maximal cliques whose first node in the peeling order is one node.

    ``later``: edges among its later neighbours.  ``bar`` adds an earlier neighbour, as the later
    ones that it is joined to; it rules out cliques that it is joined to as a whole.  Sets of later
    neighbours are whole numbers with a bit for each.
    """

    def __init__(self, node: int, later: list[tuple[int, int]]):
        self.node, self.ids = node, sorted({u for pair in later for u in pair})
        self.place = {u: k for k, u in enumerate(self.ids)}
        self.joined = [0] * len(self.ids)
        for u, w in later:
            a, b = self.place[u], self.place[w]
            self.joined[a] |= 1 << b
            self.joined[b] |= 1 << a
        self.barred: set[int] = set()

    def bar(self, others: list[int]) -> None:
        bits = 0
        for u in others:
            if u in self.place:
                bits |= 1 << self.place[u]
        if bits & (bits - 1):  # a clique of three has two later nodes at least
            self.barred.add(bits)

    def run(self) -> dict[int, int]:
        """How many cliques of three or more, by their largest node.  A stack stands for recursion."""
        found: dict[int, int] = {}
        joined = self.joined
        stack = [((1 << len(self.ids)) - 1, 0, self.barred, 1, self.node)]
        while stack:
            could, seen, barred, size, largest = stack.pop()
            if not could:
                if not seen and not barred and size >= 3:
                    found[largest] = found.get(largest, 0) + 1
                continue
            if could in barred:
                continue  # one earlier node is joined to all that could come
            best, most = 0, -1
            rest = could | seen
            while rest:
                bit = rest & -rest
                rest ^= bit
                reach = joined[bit.bit_length() - 1] & could
                if (n := reach.bit_count()) > most:
                    best, most = reach, n
            for bits in barred:
                if (n := bits.bit_count()) > most:
                    best, most = bits, n
            todo = could & ~best
            while todo:
                bit = todo & -todo
                todo ^= bit
                k = bit.bit_length() - 1
                next_could = could & joined[k]
                stack.append((next_could, seen & joined[k], {b & next_could for b in barred if b & bit}, size + 1, max(largest, self.ids[k])))
                could ^= bit
                seen |= bit
        return found


def maximal_cliques(graph: Graph) -> DataFrame:
    """(id, cliques): the maximal cliques of three or more whose largest member the node is; nodes
    without any are absent.  The graph is symmetric; loops and repeated edges are left out.

    Nodes are put in an order (:func:`peeled`) in which none has many later neighbours, whatever
    its degree.  Each clique is found at its first node, among that node's later neighbours.
    Earlier ones only rule cliques out: they are streamed past, and of those joined to the same
    later neighbours one is kept.  Every step before that is a join that gives triangles.
    """
    edges = written(graph.edges.where("from_node <> to_node").select("from_node", "to_node").distinct(), "simple")
    levels = written(peeled(edges), "levels")
    at = lambda n: levels.select(F.col("id").alias(n), F.struct("level", F.col("id").alias("k")).alias(f"at_{n}"))
    once = edges.where("from_node < to_node").join(at("from_node"), "from_node").join(at("to_node"), "to_node")
    first = F.col("at_from_node") < F.col("at_to_node")
    later = once.select(F.when(first, F.col("from_node")).otherwise(F.col("to_node")).alias("a"), F.when(first, F.col("to_node")).otherwise(F.col("from_node")).alias("b"), F.greatest("at_from_node", "at_to_node").alias("at_b"))
    later = written(later, "later")
    wedge = later.alias("p").join(later.alias("q"), F.col("p.a") == F.col("q.a")).where(F.col("p.at_b") < F.col("q.at_b")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("q.b").alias("c"))
    three = written(wedge.join(later.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c"), "triangles")
    inner = three.select(F.col("a").alias("v"), F.lit(0).alias("kind"), F.array("b", "c").alias("nodes"))
    outer = three.groupBy(F.col("b").alias("v"), "a").agg(F.sort_array(F.collect_list("c")).alias("nodes")).where(F.size("nodes") > 1)
    outer = outer.join(three.select(F.col("a").alias("v")).distinct(), "v", "left_semi").select("v", F.lit(1).alias("kind"), "nodes").distinct()

    def search(part: Partition) -> Iterator[pa.RecordBatch]:
        links, found = [], None
        for rows in part:
            for kind, nodes in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if kind == 0:
                    links.append(nodes)
                    continue
                found = found or CliqueSearch(part.key[0], links)
                found.bar(nodes)
        counts = (found or CliqueSearch(part.key[0], links)).run()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["id", "cliques"])

    rows = inner.unionByName(outer).select(F.col("v").cast("bigint"), "kind", F.col("nodes").cast("array<bigint>"))
    counts = in_phases(rows, [Phase(search, "id bigint, cliques bigint", ("v",), ("kind",))])
    return counts.groupBy("id").agg(F.sum("cliques").alias("cliques"))

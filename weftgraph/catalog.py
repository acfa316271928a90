"""The registered graph queries, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.functions import phases as P
from weftgraph.functions import table_functions as T
from weftgraph.functions.aggregates import exact_gcd, exact_product, gcd
from weftgraph.functions.packed import common_counts, pack_lists, packed_triangle_count
from weftgraph.functions.transforms import transform
from weftgraph.graph import Graph
from weftgraph.operators import degrees, factors, neighbourhoods, paths, ranks, relational
from weftgraph.operators.components import connected_components
from weftgraph.plans.lineage import release, shared_dir, written
from weftgraph.plans.pregel import pregel_pagerank_until
from weftgraph.sources import derived as D
from weftgraph.sources.derived import Derived, duck
from weftgraph.sources import layout
from weftgraph.sources import parts as parts_source
from weftgraph.sources import text as text_source
from weftgraph.sources.text import ring as ring_rows
from weftgraph.streaming.degrees import streaming_degrees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Registered like QUERIES, but without SQL; tests hold these against plain versions.
WITHOUT_SQL: dict[str, Query] = {}

#: Thresholds at which the derived graphs have some answers.
OVERLAP, TIES, FAMILY_OVERLAP, FAMILY_TIES = 3, 1000, 1, 100
ITERATIONS = 10

VIEWS = {
    "node": duck(D.NODE), "edge": duck(D.EDGE), "ratings": duck(D.RATINGS),
    "uedge": duck(D.UEDGE, edge="edge"), "edge_meta": duck(D.EDGE_META, edge="edge"), "uedge_meta": duck(D.EDGE_META, edge="uedge"),
    "node_meta": duck(D.NODE_META, node="node"),
    "family": "SELECT from_node, to_node, weight FROM edge_meta WHERE type = 'Family'",
    "ufamily": "SELECT from_node, to_node FROM uedge_meta WHERE type = 'Family'",
}
NEEDS = {"uedge": ["edge"], "edge_meta": ["edge"], "uedge_meta": ["edge", "uedge"], "node_meta": ["node"], "family": ["edge", "edge_meta"], "ufamily": ["edge", "uedge", "uedge_meta"]}


def sql(body: str, *views: str, recursive: bool = False, **steps: str) -> str:
    """``body`` over the named derived tables, then ``steps`` as further common tables."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    tables = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names] + [f"{n} AS MATERIALIZED ({text})" for n, text in steps.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(tables)} {body}"


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Derived], DataFrame]], Callable]:
    """Register a function of the derived tables as query ``name``."""

    def add(f: Callable[[Derived], DataFrame]) -> Callable:
        f.__code__ = f.__code__.replace(co_name=name, co_qualname=name)  # so that a stack trace names the query
        (WITHOUT_SQL if oracle is None else QUERIES)[name] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Scans, selections, degrees


@query("edge_scan", sql("SELECT from_node, to_node FROM edge", "edge"))
def _(d):
    return d.edge


@query("node_scan", sql("SELECT id, 0 AS value FROM node", "node"))
def _(d):
    return d.node.select("id", F.lit(0).alias("value"))


@query("ring_generator", "SELECT i AS id, CAST(i * 10 AS DOUBLE) AS value, (i + 1) % 1000 AS to_node, CAST(i * 100 AS DOUBLE) AS weight FROM range(1000) t(i)")
def _(d):
    return ring_rows(d.spark, 1000)


@query("node_filter_a6", sql("SELECT id, a6, a33, a51 FROM node_meta WHERE a6 = 4", "node_meta"))
def _(d):
    return d.node_meta.where("a6 = 4").select("id", "a6", "a33", "a51")


@query("edge_filter_family", sql("SELECT * FROM edge_meta WHERE type = 'Family'", "edge_meta"))
def _(d):
    return Graph(d.node, d.edge_meta).filter_edges(F.col("type") == "Family").edges


@query("induced_subgraph", sql("SELECT e.from_node, e.to_node FROM edge e JOIN node_meta a ON e.from_node = a.id JOIN node_meta b ON e.to_node = b.id WHERE a.a6 = 4 AND b.a6 = 4", "edge", "node_meta"))
def _(d):
    return Graph(d.node_meta, d.edge).filter_nodes(F.col("a6") == 4).edges


@query("symmetrize", sql("SELECT * FROM uedge", "uedge"))
def _(d):
    return d.graph().symmetric().edges


@query("out_degree", sql("SELECT from_node AS id, count(*) AS degree FROM edge GROUP BY from_node", "edge"))
def _(d):
    return d.graph().out_degrees()


@query("in_degree", sql("SELECT to_node AS id, count(*) AS degree FROM edge GROUP BY to_node", "edge"))
def _(d):
    return d.graph().in_degrees()


@query("degrees_of_stream", sql("SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT from_node AS id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT to_node, 0, 1 FROM edge) GROUP BY id", "edge"))
def _(d):
    return streaming_degrees(d.edge)


@query("self_loop_and_dup_audit", """
    WITH e AS (SELECT l_orderkey % 100 AS from_node, l_partkey % 100 AS to_node FROM lineitem), u AS (SELECT DISTINCT from_node, to_node FROM e)
    SELECT (SELECT count(*) FROM e) AS edges, count(*) AS distinct_edges, count(*) FILTER (u.from_node = u.to_node) AS self_loops,
        count(b.from_node) AS reciprocal, count(*) FILTER (u.from_node NOT IN (SELECT p_partkey FROM part WHERE p_partkey < 90) OR u.to_node NOT IN (SELECT p_partkey FROM part WHERE p_partkey < 90)) AS dangling_ends
    FROM u LEFT JOIN u b ON u.from_node = b.to_node AND u.to_node = b.from_node""")
def _(d):
    edges = d.tables["lineitem"].select((F.col("l_orderkey") % 100).alias("from_node"), (F.col("l_partkey") % 100).alias("to_node"))
    return Graph(d.node.where("id < 90"), edges).audit()


@query("metadata_wide_scan", sql("SELECT a6, count(*) AS n, sum(a33) AS total, min(a51) AS low FROM node_meta WHERE a7 <> 3 GROUP BY a6", "node_meta"))
def _(d):
    return d.node_meta.where("a7 <> 3").groupBy("a6").agg(F.count("*").alias("n"), F.sum("a33").alias("total"), F.min("a51").alias("low"))


# Ranks

_N = "(SELECT count(*) FROM node)"


def _pagerank_sql(edge: str, mode: str, tail: str, rounds: int = ITERATIONS, **more: str) -> str:
    steps = {"deg": f"SELECT from_node, count(*) AS d FROM {edge} GROUP BY from_node", "r0": f"SELECT id, CAST(1 AS DOUBLE) / {_N} AS value FROM node"}
    for i in range(rounds):
        given = f"SELECT e.to_node AS id, sum(r.value / g.d) AS s FROM {edge} e JOIN deg g ON e.from_node = g.from_node JOIN r{i} r ON r.id = e.from_node GROUP BY e.to_node"
        value = f"CAST(0.15 AS DOUBLE) / {_N} + CAST(0.85 AS DOUBLE) *"
        steps[f"r{i + 1}"] = f"SELECT id, {value} s AS value FROM ({given})" if mode == "inner" else f"SELECT n.id, {value} coalesce(x.s, 0) AS value FROM node n LEFT JOIN ({given}) x ON n.id = x.id"
    return sql(tail.format(r=f"r{rounds}"), "node", edge, **steps, **more)


_RANKS = "SELECT id, round(value, 8) AS value FROM {r}"


@query("pagerank", _pagerank_sql("edge", "standard", _RANKS))
def _(d):
    return rounded(ranks.pagerank(d.graph(), ITERATIONS), "value")


# short decimals fall on the borders of round(); single precision has none there
@query("pagerank_sparse", _pagerank_sql("edge", "standard", "SELECT id, CAST(value AS FLOAT) AS value FROM {r}"))
def _(d):
    return ranks.pagerank(d.graph(), ITERATIONS).withColumn("value", F.col("value").cast("float"))


@query("pagerank_inner", _pagerank_sql("edge", "inner", "SELECT id, CAST(value AS FLOAT) AS value FROM {r}"))
def _(d):
    return ranks.pagerank(d.graph(), ITERATIONS, mode="inner").withColumn("value", F.col("value").cast("float"))


@query("pagerank_family", _pagerank_sql("family", "standard", _RANKS))
def _(d):
    return rounded(ranks.pagerank(d.graph("edge_meta").filter_edges(F.col("type") == "Family"), ITERATIONS), "value")


@query("pagerank_aggregators", _pagerank_sql("edge", "standard", "SELECT count(*) AS n, round(min(value), 8) AS low, round(max(value), 8) AS high, round(sum(value), 8) AS total FROM {r}"))
def _(d):
    return rounded(ranks.rank_summary(ranks.pagerank(d.graph(), ITERATIONS)), "low", "high", "total")


@query("pagerank_outbound_step", sql(f"SELECT from_node AS id, round(CAST(1 AS DOUBLE) / {_N} / count(to_node), 12) AS new_value FROM edge GROUP BY from_node", "node", "edge"))
def _(d):
    n = d.node.count()
    return rounded(ranks.outbound_step(d.edge, d.node.withColumn("value", F.lit(1.0 / n))), "new_value", digits=12)


@query("pagerank_incoming_step", sql(
    f"SELECT e.to_node AS id, round(CAST(0.15 AS DOUBLE) / {_N} + CAST(0.85 AS DOUBLE) * sum(o.new_value), 10) AS value FROM edge e JOIN outb o ON e.from_node = o.id GROUP BY e.to_node",
    "node", "edge", outb=f"SELECT from_node AS id, CAST(1 AS DOUBLE) / {_N} / count(to_node) AS new_value FROM edge GROUP BY from_node"))
def _(d):
    n = d.node.count()
    edges = d.edge
    return rounded(ranks.incoming_step(edges, ranks.outbound_step(edges, d.node.withColumn("value", F.lit(1.0 / n))), n), "value", digits=10)


_E = "(SELECT count(*) FROM edge)"


def _linerank_sql(tail: str, last: int = ITERATIONS) -> str:
    steps = {"l0": f"SELECT from_node, to_node, CAST(1 AS DOUBLE) / {_E} AS value FROM edge"}
    for i in range(last):
        out = f"SELECT e.to_node, e.value / f.n AS v FROM l{i} e JOIN (SELECT from_node, count(*) AS n FROM l{i} GROUP BY from_node) f ON e.to_node = f.from_node"
        steps[f"l{i + 1}"] = f"SELECT e.from_node, e.to_node, CAST(0.15 AS DOUBLE) / {_E} + CAST(0.85 AS DOUBLE) * o.s AS value FROM l{i} e JOIN (SELECT to_node, sum(v) AS s FROM ({out}) GROUP BY to_node) o ON e.from_node = o.to_node"
    return sql(tail.format(r=f"l{last}"), "node", "edge", **steps)


@query("linerank_outbound_step", sql(f"SELECT from_node, to_node, round(CAST(1 AS DOUBLE) / {_E} / len(nb), 12) AS new_value FROM edge JOIN nbs ON nbs.id = to_node", "edge", nbs="SELECT from_node AS id, list(to_node) AS nb FROM edge GROUP BY from_node"))
def _(d):
    edges = written(d.edge, "edges")
    return rounded(ranks.linerank_outbound(edges.withColumn("value", F.lit(1.0 / max(1, edges.count())))), "new_value", digits=12)


@query("linerank", _linerank_sql("SELECT from_node, to_node, round(value, 9) AS value FROM {r}"))
def _(d):
    return rounded(ranks.linerank(d.graph(), ITERATIONS), "value", digits=9)


@query("linerank_node_rank", _linerank_sql("SELECT n.id, round(sum(e.value), 8) AS value FROM node n JOIN {r} e ON n.id = e.to_node GROUP BY n.id"))
def _(d):
    return rounded(ranks.linerank_of_nodes(ranks.linerank(d.graph(), ITERATIONS), d.node), "value")


# Paths and components


def _sssp_sql(edge: str, weight: str = "1", source: str = "0") -> str:
    found = (
        f"r(id, value) USING KEY (id) AS (SELECT id, CAST(0 AS DOUBLE) FROM node WHERE id = {source} UNION "
        f"SELECT e.to_node, min(r.value + {weight}) FROM r JOIN {edge} e ON r.id = e.from_node LEFT JOIN recurring.r x ON x.id = e.to_node WHERE x.value IS NULL OR r.value + {weight} < x.value GROUP BY e.to_node)"
    )
    head = sql("", "node", edge, recursive=True)
    return f"{head.rstrip()}, {found} SELECT n.id, r.value FROM node n LEFT JOIN r ON n.id = r.id"


@query("sssp", _sssp_sql("edge"))
def _(d):
    return paths.shortest_paths(d.graph(), 0)


@query("sssp_weighted", _sssp_sql("edge_meta", "e.weight"))
def _(d):
    return paths.shortest_paths(d.graph("edge_meta"), 0, weight="weight")


@query("sssp_family", _sssp_sql("family"))
def _(d):
    return paths.shortest_paths(d.graph("edge_meta").filter_edges(F.col("type") == "Family"), 0)


@query("sssp_step", sql("""SELECT id, best AS value FROM (SELECT to_node AS id, CAST(min(from_node % 50) + 1 AS DOUBLE) AS best FROM edge WHERE from_node IN (SELECT id FROM node) GROUP BY to_node)
    WHERE id IN (SELECT id FROM node) AND best < id % 50""", "edge", "node"))  # fmt: skip
def _(d):
    state = d.node.select("id", (F.col("id") % 50).cast("double").alias("value"))
    return paths.improve(d.edge, state, state)


@query("state_merge", sql("SELECT n.id, coalesce(u.value, n.id) AS value FROM node n LEFT JOIN (SELECT id, id * 10 AS value FROM node WHERE id % 3 = 0) u ON n.id = u.id", "node"))
def _(d):
    return paths.merge_state(d.node.select("id", F.col("id").alias("value")), d.node.where("id % 3 = 0").select("id", (F.col("id") * 10).alias("value")))


@query("update_from", sql("SELECT n.id, CASE WHEN g.d IS NOT NULL THEN g.d ELSE 0 END AS value FROM node n LEFT JOIN (SELECT to_node, count(*) AS d FROM edge GROUP BY to_node) g ON n.id = g.to_node", "node", "edge"))
def _(d):
    found = d.graph().in_degrees().withColumnRenamed("degree", "value")
    return paths.merge_state(d.node.select("id", F.lit(0).cast("bigint").alias("value")), found)


def _components_sql(edge: str, column: str = "component") -> str:
    both = f"s AS (SELECT from_node AS a, to_node AS b FROM {edge} UNION SELECT to_node, from_node FROM {edge})"
    found = "r(id, c) USING KEY (id) AS (SELECT id, id FROM node UNION SELECT s.b, min(r.c) FROM r JOIN s ON r.id = s.a JOIN recurring.r x ON x.id = s.b WHERE r.c < x.c GROUP BY s.b)"
    return f"{sql('', 'node', edge, recursive=True).rstrip()}, {both}, {found} SELECT id, c AS {column} FROM r"


@query("connected_components", _components_sql("edge"))
def _(d):
    return connected_components(d.node, d.edge)


@query("connected_components_family", _components_sql("family"))
def _(d):
    g = d.graph("edge_meta").filter_edges(F.col("type") == "Family")
    return connected_components(g.nodes, g.edges)


# Neighbourhoods


#: Each node's neighbours (or, of a receiver, its senders) as a sorted list.
_LISTS = "SELECT from_node AS id, list(to_node ORDER BY to_node) AS nb FROM {e} GROUP BY from_node"
#: The nodes that both ends of an edge have as neighbours.
_SHARED = "SELECT least(e.from_node, e.to_node) AS lo, greatest(e.from_node, e.to_node) AS hi, list_intersect(a.nb, b.nb) AS common FROM (SELECT DISTINCT from_node, to_node FROM {e} WHERE from_node < to_node) e JOIN nbs a ON a.id = e.from_node JOIN nbs b ON b.id = e.to_node"


def _triangle_sql(e: str) -> str:
    """A triangle is an edge with a common neighbour beyond its larger end."""
    return sql("SELECT CAST(coalesce(sum(len(list_filter(common, lambda x: x > hi))), 0) AS BIGINT) AS triangles FROM shared", e, nbs=_LISTS.format(e=e), shared=_SHARED.format(e=e))


def _per_node_sql(e: str) -> str:
    """A node is in as many triangles as its edges have common neighbours, each seen from two edges."""
    ends = "SELECT lo AS id, len(common) AS n FROM shared UNION ALL SELECT hi, len(common) FROM shared"
    return sql(f"SELECT id, sum(n) / 2e0 AS triangles FROM ({ends}) GROUP BY id HAVING sum(n) > 0", e, nbs=_LISTS.format(e=e), shared=_SHARED.format(e=e))


def _overlap_sql(e: str, threshold: int) -> str:
    """Senders of a receiver as a list, each with those after it, then how often two come together."""
    senders = f"SELECT list(from_node ORDER BY from_node) AS s FROM {e} GROUP BY to_node"
    pairs = "SELECT n1, unnest(list_filter(s, lambda x: x > n1)) AS n2 FROM (SELECT s, unnest(s) AS n1 FROM senders)"
    return sql(f"SELECT n1, n2, count(*) AS overlap FROM ({pairs}) GROUP BY ALL HAVING overlap > {threshold}", e, senders=senders)


def _ties_sql(e: str, threshold: int) -> str:
    return sql(f"""SELECT e1.from_node AS id, CAST(sum(CASE WHEN e3.to_node IS NULL THEN 1 ELSE 0 END) AS BIGINT) / 2 AS ties
        FROM {e} e1 JOIN {e} e2 ON e1.from_node = e2.from_node AND e1.to_node <> e2.to_node LEFT JOIN {e} e3 ON e1.to_node = e3.from_node AND e2.to_node = e3.to_node
        GROUP BY e1.from_node HAVING CAST(sum(CASE WHEN e3.to_node IS NULL THEN 1 ELSE 0 END) AS BIGINT) / 2 > {threshold}""", e)  # fmt: skip


def _family(d: Derived) -> Graph:
    return Graph(d.node, d.uedge_meta).filter_edges(F.col("type") == "Family").materialised()


@query("triangle_count", _triangle_sql("uedge"))
def _(d):
    return neighbourhoods.triangle_count(d.graph("uedge").materialised())


@query("triangle_count_family", _triangle_sql("ufamily"))
def _(d):
    return neighbourhoods.triangle_count(_family(d))


@query("triangle_count_per_node", _per_node_sql("uedge"))
def _(d):
    return neighbourhoods.triangles_per_node(d.graph("uedge").materialised())


@query("triangle_count_per_node_family", _per_node_sql("ufamily"))
def _(d):
    return neighbourhoods.triangles_per_node(_family(d))


@query("strong_overlap", _overlap_sql("uedge", OVERLAP))
def _(d):
    return neighbourhoods.strong_overlap(d.graph("uedge").materialised(), OVERLAP)


@query("strong_overlap_family", _overlap_sql("ufamily", FAMILY_OVERLAP))
def _(d):
    return neighbourhoods.strong_overlap(_family(d), FAMILY_OVERLAP)


@query("strong_overlap_per_node", sql(
    "SELECT n2 AS id, count(*) AS partners FROM o GROUP BY n2", "uedge",
    o=f"SELECT e1.from_node AS n1, e2.from_node AS n2 FROM uedge e1 JOIN uedge e2 ON e1.to_node = e2.to_node AND e1.from_node < e2.from_node GROUP BY ALL HAVING count(*) >= {OVERLAP}"))
def _(d):
    return neighbourhoods.overlap_per_node(d.graph("uedge").materialised(), OVERLAP)


@query("weak_ties", _ties_sql("uedge", TIES))
def _(d):
    return neighbourhoods.weak_ties(d.graph("uedge").materialised(), TIES)


@query("weak_ties_family", _ties_sql("ufamily", FAMILY_TIES))
def _(d):
    return neighbourhoods.weak_ties(_family(d), FAMILY_TIES)


@query("maximal_cliques", """WITH RECURSIVE edge AS MATERIALIZED ({edge}), uedge AS MATERIALIZED ({uedge}),
    adj AS MATERIALIZED (SELECT from_node AS id, list(to_node) AS nb FROM uedge GROUP BY from_node),
    grow AS (
        SELECT id AS last, 1 AS size, nb AS common FROM adj
        UNION ALL
        SELECT v, size + 1, list_intersect(common, a.nb) FROM (SELECT last, size, common, unnest(list_filter(common, lambda x: x > last)) AS v FROM grow) g JOIN adj a ON a.id = g.v)
    SELECT last AS id, count(*) AS cliques FROM grow WHERE size >= 3 AND len(common) = 0 GROUP BY last""".format(edge=VIEWS["edge"], uedge=VIEWS["uedge"]))  # fmt: skip
def _(d):
    return neighbourhoods.maximal_cliques(d.graph("uedge").materialised())


def _gcd_sql() -> str:
    """By prime powers: a product has the sum of their counts, a gcd the least.  The products
    themselves are beyond DuckDB's largest integers; the gcds of these tables aren't."""
    steps = {
        "e": "SELECT from_node + 2 AS a, to_node + 2 AS b FROM edge",
        "top": "SELECT max(greatest(a, b)) AS m FROM e",
        "prime": "SELECT p FROM (SELECT unnest(range(2, m + 1)) AS p FROM top) WHERE len(list_filter(range(2, CAST(floor(sqrt(p)) AS BIGINT) + 1), lambda q: p % q = 0)) = 0",
        "powers": "SELECT p, CAST(pow(p, k) AS BIGINT) AS q FROM prime, top, range(1, 63) t(k) WHERE pow(p, k) <= m",
        "f": "SELECT id, p, count(*) AS k FROM (SELECT DISTINCT b AS id FROM e) JOIN powers ON id % q = 0 GROUP BY id, p",
        "above": "SELECT DISTINCT a, b FROM e WHERE a < b AND b IN (SELECT a FROM e)",
        "w": "SELECT v, p, sum(k) AS k FROM (SELECT e.a AS v, f.p, f.k FROM e JOIN f ON f.id = e.b UNION ALL SELECT id, p, k FROM f) GROUP BY v, p",
        "own": "SELECT a, p, sum(k) AS k FROM above JOIN f ON f.id = above.b GROUP BY a, p",
        "n": "SELECT a, count(*) AS n FROM above GROUP BY a",
        "shared": "SELECT a, p, min(k) AS k, count(*) AS n FROM above JOIN w ON w.v = above.b GROUP BY a, p",
        "g": "SELECT a, p, unnest(range(CAST(least(o.k, s.k) AS BIGINT))) FROM own o JOIN shared s USING (a, p) JOIN n USING (a, n)",
        "product": "SELECT a, CAST(list_reduce(list(CAST(p AS HUGEINT)), lambda x, y: x * y) AS VARCHAR) AS t FROM g GROUP BY a",
    }
    return sql("SELECT n.a AS from_node, coalesce(t, '1') AS gcd FROM n LEFT JOIN product ON product.a = n.a WHERE coalesce(t, '1') <> CAST(n.a AS VARCHAR)", "edge", **steps)


@query("cliques_gcd", _gcd_sql())
def _(d):
    e = d.edge.select((F.col("from_node") + 2).alias("from_node"), (F.col("to_node") + 2).alias("to_node"))
    return neighbourhoods.cliques_gcd(Graph.from_edges(e))


# Functions


@query("gcd_scalar", "SELECT l_partkey, l_suppkey, gcd(l_partkey, l_suppkey) AS g FROM lineitem")
def _(d):
    return d.tables["lineitem"].select("l_partkey", "l_suppkey", gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g"))


@query("agg_gcd", "SELECT l_orderkey, CAST(list_reduce(list(l_partkey), lambda a, b: gcd(a, b)) AS BIGINT) AS g FROM lineitem GROUP BY l_orderkey")
def _(d):
    return exact_gcd(d.tables["lineitem"], ["l_orderkey"], "l_partkey", "g").withColumn("g", F.col("g").cast("bigint"))


@query("agg_product", "SELECT l_orderkey, CAST(list_reduce(list(CAST(l_linenumber AS HUGEINT)), lambda a, b: a * b) AS VARCHAR) AS product FROM lineitem GROUP BY l_orderkey")
def _(d):
    return exact_product(d.tables["lineitem"], ["l_orderkey"], "l_linenumber", "product")


@query("vector_ops", """SELECT o_orderkey, round(a * c + b * k, 4) AS dot, round(3 * a, 4) AS scaled, round(a + c, 4) AS added, least(greatest(a, 1.0), 5.0) AS clamped, concat(b, ',', k) AS coded
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS a, o_custkey AS b, CAST(o_orderkey % 7 AS DOUBLE) AS c, o_orderkey % 11 AS k FROM orders)""")  # fmt: skip
def _(d):
    o = d.tables["orders"]
    u = F.array(F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double"))
    w = F.array((F.col("o_orderkey") % 7).cast("double"), (F.col("o_orderkey") % 11).cast("double"))
    coded = V.encode(F.array(F.col("o_custkey"), F.col("o_orderkey") % 11))
    return o.select("o_orderkey", F.round(V.dot(u, w), 4).alias("dot"), F.round(V.scale(u, 3.0)[0], 4).alias("scaled"), F.round(V.add(u, w)[0], 4).alias("added"), V.clamp(u[0], 1.0, 5.0).alias("clamped"), coded.alias("coded"))


# Factorisation


def _sgd_sql(tail: str, updates: int = 4) -> str:
    steps = {
        "ways": "SELECT \"user\" AS src, item AS dst, rating FROM ratings UNION SELECT item, \"user\", rating FROM ratings",
        "v0": "SELECT DISTINCT src AS id, CAST(1 AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS y FROM ways",
    }
    for i in range(updates):
        # the list starts with the vertex's own vector; each further item is a neighbour's
        one = "lambda p, m: {'s': m.s, 'x': p.x - 0.005e0 * (0.01e0 * p.x + (least(greatest(p.x * m.x + p.y * m.y, 1e0), 5e0) - m.r) * m.x), 'y': p.y - 0.005e0 * (0.01e0 * p.y + (least(greatest(p.x * m.x + p.y * m.y, 1e0), 5e0) - m.r) * m.y), 'r': m.r}"
        heard = f"SELECT b.dst, list({{'s': b.src, 'x': v.x, 'y': v.y, 'r': b.rating}} ORDER BY b.src) AS l FROM ways b JOIN v{i} v ON b.src = v.id GROUP BY b.dst"
        steps[f"v{i + 1}"] = f"SELECT id, n.x AS x, n.y AS y FROM (SELECT v.id, list_reduce(list_prepend({{'s': CAST(-1 AS BIGINT), 'x': v.x, 'y': v.y, 'r': CAST(0 AS DOUBLE)}}, h.l), {one}) AS n FROM v{i} v JOIN ({heard}) h ON v.id = h.dst)"
    return sql(tail.format(r=f"v{updates}"), "ratings", **steps)


@query("sgd_cf", _sgd_sql("SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM {r}"))
def _(d):
    vec = factors.factorise(d.ratings)
    return vec.select("id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


@query("sgd_rmse", _sgd_sql("SELECT count(*) AS ratings, round(sqrt(avg(power(least(greatest(u.x * i.x + u.y * i.y, 1e0), 5e0) - rating, 2))), 6) AS rmse FROM ratings JOIN {r} u ON u.id = \"user\" JOIN {r} i ON i.id = item"))
def _(d):
    return rounded(factors.rmse(d.ratings, factors.factorise(d.ratings)), "rmse", digits=6)


# Before and after


@query("rank_histogram", """SELECT CASE WHEN v < 1000 THEN 0 WHEN v >= 300000 THEN 20 ELSE CAST(floor((v - 1000) / ((300000 - 1000) / 20e0)) AS BIGINT) + 1 END AS bucket, count(*) AS count
    FROM (SELECT CAST(o_totalprice AS DOUBLE) AS v FROM orders) GROUP BY 1""")  # fmt: skip
def _(d):
    return relational.rank_histogram(d.tables["orders"].select(F.col("o_totalprice").cast("double").alias("value")), 1000, 300000, 20)


@query("rank_distance_join", sql("SELECT id, value FROM (SELECT coalesce(r.id, x.id) AS id, CASE WHEN x.v < 3 THEN CAST(x.v AS DOUBLE) WHEN r.v > 0.5 THEN r.v END AS value FROM r FULL JOIN x ON r.id = x.id) WHERE value IS NOT NULL",
    "node", r="SELECT id, (id % 100) / 100e0 AS v FROM node WHERE id % 5 <> 0", x="SELECT id, id % 8 AS v FROM node WHERE id % 3 <> 0"))
def _(d):
    r = d.node.where("id % 5 <> 0").select("id", (F.col("id") % 100 / 100.0).alias("value"))
    x = d.node.where("id % 3 <> 0").select("id", (F.col("id") % 8).alias("value"))
    return relational.rank_distance_join(r, x, 0.5, 3)


@query("metadata_join", sql("SELECT coalesce(a.id, b.id) AS id, CAST(a.a6 AS DOUBLE) AS a6, a.a33, CAST(b.a7 AS DOUBLE) AS a7, b.a51 FROM (SELECT id, a6, a33 FROM node_meta WHERE a6 <> 1) a FULL JOIN (SELECT id, a7, a51 FROM node_meta WHERE a7 <> 2) b ON a.id = b.id", "node_meta"))
def _(d):
    m = d.node_meta
    return relational.metadata_join(m.where("a6 <> 1").select("id", "a6", "a33"), m.where("a7 <> 2").select("id", "a7", "a51")).withColumns({c: F.col(c).cast("double") for c in ("a6", "a7")})


@query("udtf_wire_encode", sql("SELECT from_node AS id, CAST(to_node AS DOUBLE) AS edge, CAST(NULL AS DOUBLE) AS value FROM edge UNION ALL SELECT id, NULL, CAST(99999 AS DOUBLE) FROM node", "node", "edge"))
def _(d):
    return relational.encode_wire(d.node.withColumn("value", F.lit(99999.0)), d.edge).withColumn("edge", F.col("edge").cast("double"))


@query("udtf_wire_decode", sql("SELECT n.id, count(e.to_node) AS edges, 99999e0 AS value FROM node n LEFT JOIN edge e ON n.id = e.from_node GROUP BY n.id", "node", "edge"))
def _(d):
    nodes, edges = relational.decode_wire(relational.encode_wire(d.node.withColumn("value", F.lit(99999.0)), d.edge))
    return nodes.join(edges, F.col("id") == F.col("from_node"), "left").groupBy("id", "value").agg(F.count("to_node").alias("edges"))


def _wire(d: Derived, edges: str) -> DataFrame:
    return relational.encode_wire(d.node.withColumn("value", F.lit(0.0)), getattr(d, edges))


@query("pregel_pr", _pagerank_sql("edge", "standard", _RANKS))
def _(d):
    return rounded(transform("pregel_pr", _wire(d, "edge"), numIterations=ITERATIONS), "value")


@query("pregel_sp", _sssp_sql("edge"))
def _(d):
    return transform("pregel_sp", _wire(d, "edge"), startNode=0)


@query("pregel_cc", _components_sql("edge", "value"))
def _(d):
    return transform("pregel_cc", _wire(d, "edge"))


# Table functions called from SQL, and a master that halts

#: Over so many partitions, as the table functions' callers choose them.
UDTF_PARTITIONS = 16


def _symmetric(d: Derived) -> Graph:
    """The symmetric graph, written; what was shuffled to make it goes from the disks."""
    g = d.graph("uedge").materialised()
    release(d.spark)
    return g


def _closed(d: Derived) -> tuple[Graph, DataFrame]:
    """The symmetric graph and the rows of its second superstep."""
    g = _symmetric(d)
    ranked = written(neighbourhoods.ranked_edges(g), "ranked")
    release(d.spark)
    return g, T.closed_pairs(ranked)


@query("udtf_triangle", _triangle_sql("uedge"))
def _(d):
    return T.triangles_in_sql(_closed(d)[1], UDTF_PARTITIONS)


@query("udtf_pernode_triangle", sql("SELECT id, CAST(triangles AS BIGINT) AS triangles FROM t", "uedge", t=f"SELECT * FROM ({_per_node_sql('uedge')})"))
def _(d):
    return T.pernode_triangles_in_sql(_closed(d)[1], UDTF_PARTITIONS)


@query("udtf_weak_ties", sql(
    "SELECT d.id, d.n * (d.n - 1) / 2 - coalesce(t.triangles, 0) AS ties FROM d LEFT JOIN t ON t.id = d.id WHERE ties >= 500", "uedge",
    d="SELECT from_node AS id, CAST(count(*) AS DOUBLE) AS n FROM uedge GROUP BY from_node", t=f"SELECT * FROM ({_per_node_sql('uedge')})"))
def _(d):
    g, wire = _closed(d)
    return T.weak_ties_in_sql(g.edges, T.pernode_triangles_in_sql(wire, UDTF_PARTITIONS), 500, UDTF_PARTITIONS)


@query("udtf_overlap", _overlap_sql("uedge", OVERLAP - 1))
def _(d):
    return T.strong_overlap_in_sql(T.overlap_messages(_symmetric(d).edges), OVERLAP, partitions=UDTF_PARTITIONS)


@query("udtf_strong_overlap", sql("SELECT n2 AS id, count(*) AS partners FROM o GROUP BY n2", "uedge", o=f"SELECT * FROM ({_overlap_sql('uedge', OVERLAP - 1)})"))
def _(d):
    return T.strong_overlap_in_sql(T.overlap_messages(_symmetric(d).edges), OVERLAP, per_node=True, partitions=UDTF_PARTITIONS)


#: The halting run in SQL takes so many rounds, of which those from the halt on are not looked at.
_ROUNDS = 60


def _pagerank_until_sql(tolerance: float) -> str:
    every = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(b.value - a.value)) AS change, min(b.value) AS low, max(b.value) AS high FROM r{i - 1} a JOIN r{i} b USING (id)" for i in range(1, _ROUNDS + 1))
    tail = f"SELECT i AS iterations, round(change, 10) AS change, round((SELECT min(low) FROM every x WHERE x.i <= y.i), 10) AS low, round((SELECT max(high) FROM every x WHERE x.i <= y.i), 10) AS high FROM every y WHERE i = (SELECT min(i) FROM every WHERE change < {tolerance})"
    return _pagerank_sql("edge", "standard", tail, _ROUNDS, every=every)


@query("pagerank_until", _pagerank_until_sql(1e-6))
def _(d):
    return rounded(pregel_pagerank_until(d.graph(), 1e-6)[1], "change", "low", "high", digits=10)


# Loading: written as text by the engine, and read again


def _scratch(d: Derived, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(d.spark)}/weftgraph/{name}-{uuid.uuid4().hex}"


_EDGE_SCHEMA = "from_node bigint, to_node bigint, type string, weight int, timestamp string"


@query("load_parts", sql("SELECT * FROM edge_meta WHERE type = 'Family' AND weight >= 50", "edge_meta"))
def _(d):
    """Edges written in parts and committed, then read with filters that reach the reader."""
    parts_source.register(d.spark)
    path = _scratch(d, "parts")
    d.edge_meta.repartition(6, "weight").write.format(parts_source.NAME).option("codec", "gz").mode("append").save(path)
    loaded = d.spark.read.format(parts_source.NAME).schema(_EDGE_SCHEMA).load(path)
    return loaded.where((F.col("type") == "Family") & (F.col("weight") >= 50))


@query("load_rejects", sql("""
    SELECT CASE WHEN good THEN type END AS type, count(*) FILTER (good) AS edges, CAST(coalesce(sum(weight) FILTER (good), 0) AS BIGINT) AS weight, count(*) FILTER (NOT good) AS rejects
    FROM (SELECT *, (from_node + to_node) % 11 <> 0 AND from_node % 13 <> 0 AS good FROM edge_meta) GROUP BY 1""", "edge_meta"))  # fmt: skip
def _(d):
    """Lines of which some have a weight that is no number, some lack a field: those are rejects."""
    parts_source.register(d.spark)
    path = _scratch(d, "lines")
    weight = F.concat(F.when((F.col("from_node") + F.col("to_node")) % 11 == 0, F.lit("w")).otherwise(F.lit("")), F.col("weight").cast("string"))
    line = F.concat_ws("|", "from_node", "to_node", "type", weight, F.when(F.col("from_node") % 13 != 0, F.col("timestamp")))
    d.edge_meta.select(line).write.text(path)
    read = d.spark.read.format(parts_source.NAME).schema(f"{_EDGE_SCHEMA}, rejected string").option("sep", "|").option("on_error", "keep").option("split_bytes", 100_000)
    return read.load(path).groupBy("type").agg(F.count("from_node").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.count("rejected").alias("rejects"))


@query("text_weighted_edges", sql("SELECT from_node, to_node, 1e0 AS weight FROM edge", "edge"))
def _(d):
    path = _scratch(d, "edges")
    d.edge.write.option("sep", "\t").csv(path)
    return text_source.read_edges(d.spark, path, weight=1.0)


@query("text_rated_edges", sql("SELECT \"user\", item, rating FROM ratings", "ratings"))
def _(d):
    path = _scratch(d, "ratings")
    d.ratings.write.option("sep", "\t").csv(path)
    return text_source.read_delimited(d.spark, path, text_source.RATINGS)


@query("text_labelled_nodes", sql("SELECT id, id AS value FROM node", "node"))
def _(d):
    """Nodes of components, each with its own id to start from, written as id and value."""
    path = _scratch(d, "nodes")
    text_source.write_values(d.node.withColumn("value", F.col("id")), path)
    return text_source.read_delimited(d.spark, path, text_source.LABELLED_NODES)


@query("text_vectors", sql("SELECT id, id / 4e0 AS x, -id / 8e0 AS y FROM node", "node"))
def _(d):
    """Vectors of nodes, written joined by commas."""
    path = _scratch(d, "vectors")
    text_source.write_values(d.node.select("id", F.array(F.col("id") / F.lit(4.0), -F.col("id") / F.lit(8.0)).alias("value")), path)
    vec = V.decode(F.col("value"))
    return d.spark.read.option("sep", "\t").schema("id bigint, value string").csv(path).select("id", vec[0].alias("x"), vec[1].alias("y"))


@query("text_metadata_nodes", sql(
    "SELECT id, 0e0 AS value, " + ", ".join([f"CAST(id % {i + 1} AS INTEGER) AS a{i}" for i in range(1, 33)] + [f"(id % {i}) / 4e0 AS a{i}" for i in range(33, 51)] + [f"CAST(id % {i} AS VARCHAR) AS a{i}" for i in range(51, 61)]) + " FROM node", "node"))
def _(d):
    """Nodes with all sixty attributes: 32 whole numbers, 18 real ones, 10 texts."""
    path = _scratch(d, "metadata")
    whole, real, text = [(F.col("id") % (i + 1)).alias(f"a{i}") for i in range(1, 33)], [(F.col("id") % i / F.lit(4.0)).alias(f"a{i}") for i in range(33, 51)], [(F.col("id") % i).alias(f"a{i}") for i in range(51, 61)]
    d.node.select("id", F.lit(0.0).alias("value"), *whole, *real, *text).write.option("sep", "\t").csv(path)
    return text_source.read_delimited(d.spark, path, text_source.meta_nodes())


# Several phases, and functions over ordered rows


@query("neighbour_degrees", sql(
    "SELECT a.n AS degree, b.n AS neighbour_degree, count(*) AS pairs FROM uedge e JOIN d a ON a.id = e.from_node JOIN d b ON b.id = e.to_node GROUP BY ALL", "uedge",
    d="SELECT from_node AS id, count(*) AS n FROM uedge GROUP BY from_node"))
def _(d):
    return degrees.neighbour_degrees(d.uedge)


@query("running_gcd", """
    WITH peers AS (SELECT l_suppkey, l_quantity, list_reduce(list(l_partkey), lambda a, b: gcd(a, b)) AS g FROM lineitem GROUP BY ALL),
    runs AS (SELECT l_suppkey, l_quantity, list_reduce(list(g) OVER (PARTITION BY l_suppkey ORDER BY l_quantity), lambda a, b: gcd(a, b)) AS g FROM peers)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(r.g AS BIGINT) AS g FROM lineitem JOIN runs r USING (l_suppkey, l_quantity)""")
def _(d):
    lines = d.tables["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    return P.running_by_peers(lines, "g", "l_partkey", np.gcd, exact_gcd, ["l_suppkey"], "l_quantity").drop("l_quantity")


@query("analytic_ranks", """SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense
    FROM orders WINDOW w AS (PARTITION BY o_custkey % 100 ORDER BY o_orderdate DESC)""")
def _(d):
    o = d.tables["orders"].select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 100).alias("k"))
    placed = P.with_analytic(o, "place", "bigint", P.Rank, ["k"], ["o_orderdate DESC"])
    return P.with_analytic(placed, "dense", "bigint", lambda: P.Rank(dense=True), ["k"], ["o_orderdate DESC"]).drop("k", "o_orderdate")


# Packed lists of neighbours


@query("packed_triangle_count", _triangle_sql("uedge"))
def _(d):
    return packed_triangle_count(written(neighbourhoods.ranked_edges(d.graph("uedge").materialised()), "ranked"))


@query("packed_common_neighbours", sql("SELECT lo AS a, hi AS b, len(common) AS n FROM shared WHERE len(common) > 0", "uedge", nbs=_LISTS.format(e="uedge"), shared=_SHARED.format(e="uedge")))
def _(d):
    """How many neighbours the ends of each edge share, from packed lists of all neighbours."""
    edges = written(d.uedge, "edges")
    lists = written(pack_lists(edges, "from_node", "to_node"), "packed")
    return common_counts(edges.where("from_node < to_node").select(F.col("from_node").alias("a"), F.col("to_node").alias("b")), lists, "from_node")


@query("text_ranked_nodes", sql("SELECT id, 1e0 / (SELECT count(*) FROM node) AS value FROM node", "node"))
def _(d):
    """Nodes from lines of ids, each with 1/N to start from."""
    path = _scratch(d, "ids")
    d.node.write.csv(path)
    return text_source.read_nodes(d.spark, path, 1.0 / max(1, d.node.count()))


@query("text_adjacency", sql("SELECT from_node, to_node FROM edge", "edge"))
def _(d):
    """Edges written a node and its neighbours a line, and read again."""
    path = _scratch(d, "lists")
    ends = F.concat_ws(",", F.sort_array(F.collect_list("to_node")).cast("array<string>"))
    d.edge.groupBy("from_node").agg(ends.alias("ends")).select(F.concat(F.col("from_node").cast("string"), F.lit(":"), "ends", F.lit(","))).write.text(path)
    return text_source.read_adjacency(d.spark, path)


@query("two_step_paths", sql("SELECT e1.to_node AS id, count(*) AS paths, count(DISTINCT e2.to_node) AS ends FROM edge e1 JOIN edge e2 ON e1.to_node = e2.from_node GROUP BY e1.to_node", "edge"))
def _(d):
    """Two copies of the edges in as many buckets, by either end, meet without an exchange."""
    name = f"edges_{uuid.uuid4().hex}"
    layout.save_bucketed(d.edge, name, int(d.spark.conf.get("spark.sql.shuffle.partitions")), both=True, path=_scratch(d, "buckets"))
    layout.analyse(d.spark, name)
    e1, e2 = d.spark.table(f"{name}_by_to").select(F.col("to_node").alias("id")), d.spark.table(name).select(F.col("from_node").alias("id"), "to_node")
    return e1.join(e2.hint("merge"), "id").groupBy("id").agg(F.count("*").alias("paths"), F.count_distinct("to_node").alias("ends"))

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import aggregates, vectors
from weftgraph.sources import text
from weftgraph.streaming.degrees import streaming_degrees


def test_gcd(spark):
    rows = [(12, 18), (0, 5), (-4, 6), (7, None), (0, 0)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = [r[0] for r in df.select(aggregates.gcd(F.col("a"), F.col("b"))).collect()]
    assert got == [6, 5, 2, None, 0]


def test_exact_aggregates_over_hot_keys(spark):
    random.seed(1)
    rows = [(random.choice([1, 1, 1, 2, 3]), random.randint(1, 50)) for _ in range(500)] + [(4, None), (2, 0)]
    df = spark.createDataFrame(rows, "k int, v bigint").repartition(7)
    by = {k: [v for a, v in rows if a == k and v is not None] for k in (1, 2, 3)}
    assert {r[0]: int(r[1]) for r in aggregates.exact_product(df, ["k"], "v", "p").collect()} == {k: math.prod(v) for k, v in by.items()}
    assert {r[0]: int(r[1]) for r in aggregates.exact_gcd(df, ["k"], "v", "g").collect()} == {k: math.gcd(*v) for k, v in by.items()}
    assert aggregates.exact_gcd(df.limit(0), ["k"], "v", "g").count() == 0
    wrapped = {r[0]: r[1] for r in aggregates.wrapped_product(df, ["k"], "v", "p").collect()}
    assert wrapped[1] == (math.prod(by[1]) + 2**63) % 2**64 - 2**63


def test_sql_names(spark):
    aggregates.register(spark)
    spark.createDataFrame([(1, 4), (1, 6), (2, 5)], "k int, v bigint").createOrReplaceTempView("kv")
    rows = spark.sql("SELECT k, agg_gcd(v) AS g, agg_product(v) AS p FROM kv GROUP BY k ORDER BY k").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 24), (2, 5, 5)]
    assert spark.sql("SELECT gcd(k * 6L, v) AS g FROM kv WHERE v = 4").first()[0] == 2


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [3.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(vectors.dot(a, b)).collect()] == [11.0, 0.0]
    r = df.select(vectors.scale(a, 2.0), vectors.add(a, b), vectors.decode(vectors.encode(b))).first()
    assert list(r) == [[2.0, 4.0], [4.0, 6.0], [3.0, 4.0]]


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "edges").write_text("1\t2\n2 3\n\n")
    edges = text.read_edges(spark, str(tmp_path / "edges"), weight=1.0)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 1.0), (2, 3, 1.0)]
    (tmp_path / "nodes").write_text("1\n2\n")
    assert sorted(map(tuple, text.read_nodes(spark, str(tmp_path / "nodes"), 0.5).collect())) == [(1, 0.5), (2, 0.5)]
    values = spark.createDataFrame([(1, [1.0, 2.5])], "id bigint, value array<double>")
    text.write_values(values, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1\t1.0,2.5"


def test_rejected_rows(spark, tmp_path):
    (tmp_path / "m").write_text("1\t2\tFamily\t3\t2014-01-01\nx\t2\tFriend\t3\t2014-01-01\n3\t4\tnull\t5\t2014-01-02\n")
    path = str(tmp_path / "m")
    assert text.read_delimited(spark, path, text.META_EDGES, on_error="drop").count() == 2
    kept = text.read_delimited(spark, path, text.META_EDGES, on_error="keep").cache()
    assert kept.where("rejected IS NOT NULL").count() == 1
    assert kept.where("type IS NULL AND rejected IS NULL").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        text.read_delimited(spark, path, text.META_EDGES).collect()
    family = text.read_delimited(spark, path, text.META_EDGES, on_error="drop", where=F.col("type") == "Family")
    assert [r["to_node"] for r in family.collect()] == [2]
    assert len(text.meta_nodes()) == 62


def test_ring(spark):
    assert [tuple(r) for r in text.ring(spark, 3).orderBy("id").collect()] == [(0, 0.0, 1, 0.0), (1, 10.0, 2, 100.0), (2, 20.0, 0, 200.0)]


def test_degrees_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3)], "from_node bigint, to_node bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("from_node bigint, to_node bigint").parquet(str(tmp_path / "in"))
    q = streaming_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees_test").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("degrees_test").collect())) == [(1, 2, 0), (2, 0, 1), (3, 0, 1)]


def test_bucketed_edges_join_without_an_exchange(spark):
    from weftgraph.sources.layout import analyse, save_bucketed

    edges = spark.createDataFrame([(i % 50, i * 7 % 50) for i in range(200)], "from_node bigint, to_node bigint").distinct()
    save_bucketed(edges, "edges_b", 4, both=True)
    analyse(spark, "edges_b")
    a, b = spark.table("edges_b").hint("merge"), spark.table("edges_b_by_to")
    joined = b.alias("x").join(a.alias("y"), F.col("x.to_node") == F.col("y.from_node"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() > 0
    spark.sql("DROP TABLE edges_b")
    spark.sql("DROP TABLE edges_b_by_to")


def test_command_line(capsys):
    from weftgraph.__main__ import main

    assert main(["list"]) == 0 and "pagerank" in capsys.readouterr().out
    assert main(["query", "no such query", "x"]) == 2


def test_products_of_any_length(spark):
    for n in (0, 7, -7, 10**3999, 10**4000 - 1, 10**4000, -(3**50_000), 10**20_000 + 1):
        text = aggregates.to_text(n)
        assert aggregates.from_text(text) == n and len(text) == max(1, len(text.lstrip("-").lstrip("0"))) + (n < 0)
    df = spark.range(2_000).selectExpr("1 AS k", "9000 + id % 999 AS v").repartition(4)
    want = math.prod(9000 + i % 999 for i in range(2_000))
    text = aggregates.exact_product(df, ["k"], "v", "p").first()["p"]
    assert len(text) > 7_900 and aggregates.from_text(text) == want
    again = spark.createDataFrame([(1, text), (1, "3")], "k int, v string")
    assert aggregates.from_text(aggregates.exact_gcd(again, ["k"], "v", "g").first()["g"]) == math.gcd(want, 3)
    assert aggregates.wrapped_product(df, ["k"], "v", "p").first()["p"] == (want + 2**63) % 2**64 - 2**63


def test_folding_makes_few_long_factors():
    sizes = []

    def prod(values):
        sizes.append(sum(v.bit_length() for v in values))
        return math.prod(values)

    f = aggregates.Folding(prod)
    for i in range(1, 5001):
        f.add([i])
    assert f.result() == math.factorial(5000)
    assert sum(sizes) < 12 * math.factorial(5000).bit_length()  # not one growing product, folded anew each time
    g = aggregates.Folding(lambda v: math.gcd(*v))
    g.add([12, 18])
    assert g.result() == 6
    for n in (0, 1, -1, 127, 128, -128, -129, 2**80, -(2**80)):
        assert int.from_bytes(aggregates.to_bytes(n), "big", signed=True) == n


def test_gcd_that_is_no_bigint(spark):
    df = spark.createDataFrame([(-(2**63), 0)], "a bigint, b bigint")
    with pytest.raises(Exception, match="no bigint"):
        df.select(aggregates.gcd(F.col("a"), F.col("b"))).collect()
    assert df.select(aggregates.gcd(F.col("a"), F.lit(6))).first()[0] == 2


def test_adjacency_lines(spark, tmp_path):
    (tmp_path / "lists").write_text("1:2,3,\n2:\n\n 3: 4 , 5\n4:1\n")
    got = sorted(map(tuple, text.read_adjacency(spark, str(tmp_path / "lists")).collect()))
    assert got == [(1, 2), (1, 3), (3, 4), (3, 5), (4, 1)]


def test_command_line(spark, data, tmp_path, capsys):
    from weftgraph.__main__ import main

    assert main(["list"]) == 0 and "pagerank" in capsys.readouterr().out
    assert main(["query", "triangle_count", data]) == 0 and "3287" in capsys.readouterr().out
    (tmp_path / "e.txt").write_text("1 2\n2\t3\n")
    assert main(["load", str(tmp_path / "e.txt"), str(tmp_path / "e.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "e.parquet")).count() == 2
    assert main(["nothing"]) == 2 and main(["query", "nothing", data]) == 2

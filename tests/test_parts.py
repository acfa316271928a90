"""The data source of delimited parts: ranges, compression, rejects, pushed filters, commits."""

import bz2
import glob
import gzip
import json
import os
import random

import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThanOrEqual, Not, StringStartsWith

from weftgraph.sources import parts
from weftgraph.sources.parts import PartsWriter, Parser, Range, Written, converted, lines_of, mask, ranges_of, rules_out, takes

SCHEMA = "a bigint, b string, c double"


@pytest.fixture(scope="module")
def session(spark):
    parts.register(spark)
    return spark


def read(session, path, schema=SCHEMA, **options):
    r = session.read.format(parts.NAME).schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(str(path))


def write(df, path, mode="append", **options):
    w = df.write.format(parts.NAME).mode(mode)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(str(path))


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_each_line_is_in_one_range(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(parts, "CHUNK", chunk)
    rng = random.Random(chunk)
    for end in ("", "\n"):
        lines = ["x" * rng.choice([0, 1, 2, 9, 40]) + str(i) for i in range(40)]
        path = tmp_path / f"f{chunk}{len(end)}"
        path.write_bytes(("\n".join(lines) + end).encode())
        files = pafs.LocalFileSystem()
        for split in (1, 2, 5, 16, 64, 10_000):
            found = [x for r in ranges_of(files, str(path), split) for part in lines_of(files, r) for x in part]
            assert found == [x.encode() for x in lines], (split, end)
    empty = tmp_path / "empty"
    empty.write_bytes(b"")
    assert [x for r in ranges_of(files, str(empty), 5) for x in lines_of(files, r)] == []
    assert [x for x in lines_of(files, Range(str(path), 5, 6))] in ([], [[lines[1].encode()]])


@pytest.mark.parametrize(("codec", "opened"), [("none", open), ("gz", gzip.open), ("bz2", bz2.open), ("zst", None)])
def test_round_trip(session, tmp_path, codec, opened):
    df = session.range(1000).selectExpr("id AS a", "IF(id % 7 = 0, NULL, concat('é', id)) AS b", "id / 3D AS c").repartition(5)
    write(df, tmp_path / "t", codec=codec)
    assert sorted(read(session, tmp_path / "t", split_bytes=1000).collect()) == sorted(df.collect()) if codec else True
    listed = json.loads((tmp_path / "t" / parts.MANIFEST).read_text())["files"]
    assert len(listed) == 5 and sum(f["rows"] for f in listed) == 1000
    if opened:
        text = "".join(opened(tmp_path / "t" / f["name"], "rt").read() for f in listed)
        assert text.count("\n") == 1000 and "\\N" in text


def test_append_and_overwrite(session, tmp_path):
    one = session.range(3).selectExpr("id AS a", "'x' AS b", "1D AS c")
    write(one, tmp_path / "t")
    write(one, tmp_path / "t")
    assert read(session, tmp_path / "t").count() == 6
    (tmp_path / "t" / "part-lost.txt").write_text("9\tstray\t1\n")  # of a task that was never committed
    assert read(session, tmp_path / "t").count() == 6
    write(one.where("a = 1"), tmp_path / "t", mode="overwrite")
    assert read(session, tmp_path / "t").count() == 1
    write(one.limit(0), tmp_path / "t", mode="overwrite")
    assert read(session, tmp_path / "t").count() == 0


def test_a_failed_write_leaves_nothing(session, tmp_path):
    bad = session.range(100).repartition(4).selectExpr("id AS a", "IF(id = 70, 'two\twords', 'x') AS b", "1D AS c")
    with pytest.raises(Exception, match="separator"):
        write(bad, tmp_path / "t")
    assert glob.glob(f"{tmp_path}/t/part-*") == [] and not os.path.exists(tmp_path / "t" / parts.MANIFEST)
    path = tmp_path / "u" / "part-1.txt"
    path.parent.mkdir()
    path.write_text("1\n")
    PartsWriter({"path": str(tmp_path / "u")}, False).abort([Written("part-1.txt", 1), None])
    assert not path.exists()


LINES = ["1\tx\t2.5", "two\tx\t1", "3\ty", "4\ty\t\\N", "5\tz\t1e3", "", "6\tz\tnan", "99999999999999999999\tx\t1", "7\tx\t1\textra", "8\t\\N\t.5"]


def test_rejects(session, tmp_path):
    (tmp_path / "f.txt").write_text("\n".join(LINES))
    kept = read(session, tmp_path / "f.txt", SCHEMA + ", rejected string", on_error="keep").collect()
    good = {1: ("x", 2.5), 4: ("y", None), 5: ("z", 1000.0), 8: (None, 0.5)}
    assert {r["a"]: (r["b"], r["c"]) for r in kept if r["rejected"] is None and r["a"] != 6} == good
    assert sorted(r["rejected"] for r in kept if r["rejected"] is not None) == sorted([LINES[1], LINES[2], LINES[7], LINES[8]])
    assert all(r["a"] is r["b"] is r["c"] is None for r in kept if r["rejected"] is not None)
    assert read(session, tmp_path / "f.txt", on_error="drop").count() == 5
    with pytest.raises(Exception, match="no row of a int64"):
        read(session, tmp_path / "f.txt").collect()
    for options, says in (({"on_error": "ignore"}, "none of"), ({"on_error": "keep"}, "needs a column"), ({"split_bytes": 0}, "at least 1")):
        with pytest.raises(Exception, match=says):
            read(session, tmp_path / "f.txt", **options).collect()
    with pytest.raises(Exception, match="needs a schema"):
        session.read.format(parts.NAME).load(str(tmp_path / "f.txt"))
    with pytest.raises(Exception, match="nowhere"):
        read(session, tmp_path / "nowhere").collect()


def test_broken_utf8_is_rejected():
    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    batch = Parser(schema, "\t", "\\N", "drop", "")([b"1\t\xff", "2\t�".encode(), b"3\tok\r"])
    assert batch.to_pylist() == [{"a": 2, "b": "�"}, {"a": 3, "b": "ok"}]


def test_conversion_takes_what_a_cast_takes():
    values, wrong = converted(pa.array(["1", "-2", "+3", "x", None, "9223372036854775807", "9223372036854775808"]), pa.int64())
    assert values.to_pylist() == [1, -2, None, None, None, 9223372036854775807, None] and wrong.to_pylist() == [False, False, True, True, False, False, True]
    values, wrong = converted(pa.array(["true", "false", "maybe", None]), pa.bool_())
    assert values.to_pylist() == [True, False, None, None] and wrong.to_pylist() == [False, False, True, False]


def test_filters_reach_the_reader(session, tmp_path):
    df = session.range(100).selectExpr("id AS a", "concat('t', id % 3) AS b", "IF(id % 2 = 0, NULL, id / 2D) AS c")
    write(df.repartitionByRange(4, "a"), tmp_path / "t")
    cases = ["b = 't1'", "a > 90", "a <= 3", "c IS NULL", "c IS NOT NULL AND a < 10", "b IN ('t0', 't2')", "NOT b = 't0'", "b LIKE 't1%'", "c <=> NULL", "a > 500", "a % 2 = 1", "b = 't1' OR a = 5"]
    for text in cases:
        got = read(session, tmp_path / "t").where(text)
        assert sorted(r["a"] for r in got.collect()) == sorted(r["a"] for r in df.where(text).collect()), text
    plan = read(session, tmp_path / "t").where("b = 't1'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
    listed = json.loads((tmp_path / "t" / parts.MANIFEST).read_text())["files"]
    assert sum(not rules_out(GreaterThan(("a",), 90), f) for f in listed) == 1
    assert all(rules_out(EqualTo(("b",), "zz"), f) for f in listed)


def test_masks_and_statistics():
    batch = pa.record_batch({"a": [1, None, 3], "b": ["x", "yy", None]})
    assert mask(In(("a",), (1, 2)), batch).to_pylist() == [True, None, False]
    assert mask(Not(StringStartsWith(("b",), "y")), batch).to_pylist() == [True, False, None]
    assert mask(IsNull(("a",)), batch).to_pylist() == [False, True, False] and mask(IsNotNull(("b",)), batch).to_pylist() == [True, True, False]
    assert takes(Not(EqualTo(("a",), 1)), ["a"]) and not takes(EqualTo(("z",), 1), ["a"]) and not takes(EqualTo(("a", "x"), 1), ["a"])
    stats = {"low": {"a": 5, "n": None}, "high": {"a": 9, "n": None}}
    assert rules_out(LessThanOrEqual(("a",), 4), stats) and not rules_out(LessThanOrEqual(("a",), 5), stats)
    assert rules_out(EqualTo(("n",), 1), stats) and not rules_out(EqualTo(("other",), 1), stats) and not rules_out(EqualTo(("a",), "text"), stats)
    assert rules_out(In(("a",), (1, None, 10)), stats) and not rules_out(IsNull(("a",)), stats)


def test_columns_that_have_no_place_in_text(session, tmp_path):
    for df in (session.range(1).select(F.array("id").alias("a")), session.range(1).selectExpr("'\\\\N' AS a"), session.range(1).selectExpr("concat('x', chr(10)) AS a")):
        with pytest.raises(Exception, match="no place|reads as null|line end"):
            write(df, tmp_path / "t")
    with pytest.raises(Exception, match="codec"):
        write(session.range(1), tmp_path / "t", codec="rar")

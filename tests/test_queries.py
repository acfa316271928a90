"""Every registered graph query against its SQL in DuckDB."""

import duckdb
import pytest

from weftgraph.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return sorted(map(repr, (tuple(str(v) if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    mine = QUERIES[name](spark, data).toPandas()
    theirs = duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

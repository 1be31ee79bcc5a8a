"""Every query with SQL of its own, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from rivulet.plans.oracle import ORACLE
from rivulet.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(found):
    return sorted((tuple(map(str, r)) for r in found))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_equal(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE[name]})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(expected)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(ORACLE) <= set(__spark_entry__.queries())

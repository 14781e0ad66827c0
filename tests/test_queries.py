"""Every query with SQL gives DuckDB's answer on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    answer = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(answer.columns)
    columns = sorted(df.columns)
    place = [answer.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[k]) for k in place) for r in answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "is_valid", "n_errors", "order", "total"]

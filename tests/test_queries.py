"""Every registered terrain query against its SQL, whole tables of the smallest size."""

import duckdb
import pytest

from overlook import queries

TABLES = "region nation customer supplier part orders lineitem events embeddings pages".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return (v is None, round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(v))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf_dir, sql, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in queries.ORACLES:
        assert got
        return
    want = sql.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=str)

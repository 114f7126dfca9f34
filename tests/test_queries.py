"""Each query that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def normal(rows):
    def one(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, D)
    got = normal(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in (r[i] for i in order)) for r in want.fetchall()]
    assert got == normal(rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

"""Every registered query against its SQL, on the smallest tables."""

import decimal
import os

import pytest

from tidebook.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    cur = duck.execute(SQL[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    spark.catalog.clearCache()

"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from quire.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str([plain(x) for x in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0

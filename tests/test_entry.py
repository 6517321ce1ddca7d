"""The driver contract: registered queries agree with their SQL on the smallest tables, where those are at hand."""

import os

import pytest

import __spark_entry__ as entry
from txnlens.oracles import ORACLE_SQL
from txnlens.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def canonical(value):
    if value is None or value != value:
        return "null"
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return f"{value:.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(map(canonical, r)) for r in cur.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(canonical, r)) for r in df.select(*names).collect()) == want

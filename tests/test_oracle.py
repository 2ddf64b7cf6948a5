"""The driver contract: entry() runs and every registered query agrees with
its DuckDB oracle on sf0.001 (rows-only entries just have to run)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return (1, "nan" if math.isnan(f) else repr(f))
    if isinstance(v, dt.datetime):
        return (3, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return (3, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (4, str([_norm(x) for x in v]))
    return (6, str(v))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "alert_created" in df.columns


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_against_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan   # no cross joins
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = [dcols.index(cols[i]) for i in order]
    a = sorted(tuple(_norm(r[i]) for i in order) for r in srows)
    b = sorted(tuple(_norm(r[i]) for i in dorder) for r in drows)
    assert a == b

"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import ROOT, duck, rows_of

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


OWN = sorted(k for m in entry._modules() for k in m.QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, f"{ROOT}/{SF}")
    got = rows_of(df.columns, df.collect())
    spark.catalog.clearCache()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "client_id"

import os

import pytest

import __spark_entry__ as entry

from .conftest import DATA

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    sql = entry.oracle_sql().get(name)
    if sql:
        expected = oracle.execute(sql)
        columns = [c[0] for c in expected.description]
        assert canonical(rows, df.columns) == canonical(expected.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["a", "b"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

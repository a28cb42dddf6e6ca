"""Every query against its SQL on the smallest tables, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as contract
from opinionweave.catalog import QUERIES

SF = contract.ENTRY_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = contract.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    rows = [tuple(r) for r in df.collect()]
    statement = contract.oracle_sql().get(name)
    if statement is None:
        assert rows
        return
    cursor = sql.execute(statement)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), columns)

import os

import pytest

import __spark_entry__ as contract
from opinionweave.catalog import QUERIES, SQL


def test_names_agree():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(contract.ENTRY_DIR), reason="test tables not present")
def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 5 and all(r.insufficient_data and r.value is None and "BELOW_MIN_N" in r.limitations for r in rows)

"""Every registered query against its DuckDB twin at sf0.001 (the round driver runs the same at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract_shapes():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "start_line", "similarity", "rank"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    pdf = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(pdf) > 0
        return
    err = compare(pdf, con.execute(sql).df())
    assert err is None, err

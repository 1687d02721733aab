"""Every query with SQL gives the SQL's rows; the others run."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    run = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert run(spark, SF_DIR).count() >= 0
    else:
        assert oracle.compare(spark, con, run, sql, SF_DIR) is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 <= row.recall_at_5 <= row.recall_at_10 <= 1

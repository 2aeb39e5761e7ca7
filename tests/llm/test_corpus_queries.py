"""Registered corpus queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from batchloom.llm.queries import ORACLE, QUERIES
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    con = connect(FOLDER)
    try:
        assert compare(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER) == ""
    finally:
        con.close()


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())

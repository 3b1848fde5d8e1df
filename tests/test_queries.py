"""Every query against its SQL on the smallest data folder."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, con, name):
    said = compare(spark, con, name, SF_DIR)
    assert said.startswith("same"), said

"""Every registered analytics query against its DuckDB counterpart, on the smallest data folder."""

import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from userbaseline.plans import catalog, oracle

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier events documents labels".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.6f}"
    return str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_left_out_whole_where_a_module_is_missing():
    """Without an optional module the analytics queries stay, and nothing else does."""
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(said.stdout) == len(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.columns, got.collect()) == canonical(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

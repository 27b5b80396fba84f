"""Every registered query against its SQL, and rules for all plans."""

import re

import duckdb
import pytest
from check import compare, connect

import __spark_entry__ as entry

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, sf, name):
    problem, rows = compare(spark, db, name, sf)
    assert problem is None
    assert rows > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry_has_stable_columns(spark):
    df = entry.entry(spark)
    assert df.columns == ["machine_id", "host_name", "ips", "cpu", "memory", "nics", "created_at", "updated_at"]


# the optional queries run jobs while they are built; their plans are looked at in their own tests
LAZY = [n for n in NAMES if not n.startswith(("stm_", "snk_fanout", "snk_upsert", "op", "pipeline"))]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_and_no_python(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|EvalPython|MapInPandas", plan)


def test_lease_stream_matches_sql_on_null_columns(spark, tmp_path):
    """Orders without a date, status or customer."""
    db = duckdb.connect()
    db.execute(f"""COPY (SELECT i AS o_orderkey, CASE WHEN i % 7 <> 3 THEN i % 9 END AS o_custkey,
        CASE WHEN i % 5 <> 1 THEN ['F', 'O', 'P'][i % 3 + 1] END AS o_orderstatus,
        CASE WHEN i % 4 <> 2 THEN TIMESTAMP '1995-01-01' + to_days(CAST(i AS INTEGER)) END AS o_orderdate
        FROM range(200) t(i)) TO '{tmp_path}/orders.parquet'""")
    db.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet')")
    problem, rows = compare(spark, db, "stm_leases", str(tmp_path))
    assert problem is None
    assert rows > 0

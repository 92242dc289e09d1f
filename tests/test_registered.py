"""Every registered query against its SQL counterpart, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as registered
from compare import TABLES, rows_of
from tests.conftest import plan_of

SF_DIR = "/root/testdata/sf0.001"
NAMES = list(registered._reference_queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_a_counterpart():
    assert set(registered.oracle_sql()) >= set(NAMES) and set(registered.queries()) >= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registered.queries()[name](spark, SF_DIR)
    found = duck.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    assert len(ours) > 0
    assert ours == theirs
    # Even where nothing may be broadcast there is neither a nested loop nor a cross join.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(df.select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    assert registered.entry(spark).columns[:3] == ["space_id", "brand", "waehrung"]

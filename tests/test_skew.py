"""Lookups with heavy keys: same rows as a plain join, spread evenly without the runtime's help."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kassenwerk.operators import enrich
from kassenwerk.operators.skew import heavy_keys, lookup
from tests.conftest import plan_of

PARTS = 8


@pytest.fixture
def shuffled(spark):
    """Neither broadcasts of Spark's own choice nor run-time changes of the plan."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": str(PARTS),
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture
def sales(spark):
    """90 % in one space, 3 % without one, the rest in 300 others."""
    space = F.when(F.col("id") % 100 < 90, 7).when(F.col("id") % 100 < 93, None).otherwise(100 + F.col("id") % 300)
    return spark.range(20_000).select("id", space.cast("bigint").alias("spaceid"), (F.col("id") % 3).alias("kind"))


@pytest.fixture
def spaces(spark):
    return spark.createDataFrame([(7, 70, "x"), (150, 15, None), *[(i, i * 2, f"n{i}") for i in range(200, 400)]], "spaceid long, account long, name string")


def load(df):
    return sorted(df.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"])


def test_heavy_keys(spark, sales):
    assert [r._token for r in heavy_keys(sales, ["spaceid"]).collect()] == ["7\x1f"]
    both = {r._token for r in heavy_keys(sales, ["spaceid", "kind"]).collect()}
    assert both == {f"7\x1f{k}\x1f" for k in range(3)}
    assert heavy_keys(sales.limit(0), ["spaceid"]).count() == 0


def test_lookup_equals_a_left_join(sales, spaces, shuffled):
    want = sales.join(spaces, "spaceid", "left").select("id", "spaceid", "kind", "account", "name")
    found = lookup(sales, spaces, ["spaceid"])
    assert found.columns == want.columns and Counter(found.collect()) == Counter(want.collect())
    without = spaces.filter("spaceid != 7")
    found = lookup(sales, without, ["spaceid"], sales)
    assert Counter(found.collect()) == Counter(sales.join(without, "spaceid", "left").select(found.columns).collect())


def test_a_dominant_space_spreads_evenly(sales, spaces, shuffled):
    plain = load(sales.join(spaces, "spaceid", "left"))
    assert plain[-1] >= 0.9 * 20_000
    for table in (spaces, spaces.filter("spaceid != 7")):
        spread = load(lookup(sales, table, ["spaceid"]))
        assert len(spread) == PARTS and spread[-1] < 1.3 * 20_000 / PARTS


def test_accounts_of_a_dominant_space(make_tables, sales, shuffled):
    tables = make_tables(spacereference=[{"spaceid": 7, "accountid": 1}, {"spaceid": 7, "accountid": 2}, {"spaceid": 250, "accountid": 3}])
    found = enrich.with_account(tables, sales)
    assert load(found)[-1] < 1.3 * 20_000 / PARTS
    got = {r.spaceid: r.accountid for r in found.collect()}
    assert got[7] == 1 and got[None] is None and {v for k, v in got.items() if k not in (7, None)} <= {None, 3}


def test_a_lookup_within_the_broadcast_limit_is_joined_plainly(spark, sales, spaces, tmp_path):
    spaces.write.parquet(f"{tmp_path}/spaces")
    spaces = spark.read.parquet(f"{tmp_path}/spaces")
    assert "approx_top_k" not in plan_of(lookup(sales, spaces, ["spaceid"]))

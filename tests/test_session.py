"""Membership sketches: fact scans are filtered by a report's ids before anything is shuffled."""

import pytest

from kassenwerk.operators import enrich
from kassenwerk.operators.filters import report_transactions
from kassenwerk.session import MOST_SKETCH_BITS, membership_settings
from kassenwerk.sources.derived import SPACES, derived_tables
from tests.conftest import plan_of

PERIOD = (list(range(SPACES)), "1996-02-10 00:00:00", "1996-03-01 00:00:00")


@pytest.fixture
def sketched(spark):
    settings = membership_settings(100_000, fact_bytes=0) | {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


SIDES = {
    "tips": lambda t, tx: enrich.tips(t, tx),
    "records": lambda t, tx: enrich.record_counts(t, tx),
    "existence": lambda t, tx: enrich.has_record(t, tx),
    "cards": lambda t, tx: enrich.cards(t, tx),
    "bank": lambda t, tx: enrich.bank_rows(t, tx),
}


@pytest.mark.parametrize("side", SIDES)
def test_fact_scans_are_filtered_before_the_shuffle(spark, sketched, side):
    tables = derived_tables(spark, "/root/testdata/sf0.001")
    df = SIDES[side](tables, report_transactions(tables, *PERIOD))
    plan = plan_of(df).splitlines()
    # Below an exchange, so with a greater indentation than one above it.
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    sketched_at = [i for i, line in enumerate(plan) if "might_contain" in line]
    assert sketched_at
    for i in sketched_at:
        assert any("Exchange hashpartitioning" in line and depth(line) < depth(plan[i]) for line in plan[:i])
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")
    plain = SIDES[side](tables, report_transactions(tables, *PERIOD))
    assert sorted(map(repr, df.collect())) == sorted(map(repr, plain.collect())) != []


def test_a_sketch_has_a_bound():
    bits = lambda n: int(membership_settings(n)["spark.sql.optimizer.runtime.bloomFilter.maxNumBits"])
    assert bits(1000) == 8000 and bits(10**12) == MOST_SKETCH_BITS

"""Time lookups against brute force, with ties, day edges, gaps and one dominant scope."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kassenwerk.operators.timeline import events_before, following_events, pairs_by_whole_days
from tests.conftest import plan_of

BASE = datetime(2026, 3, 20)


def moments(rng, count, hot):
    """(scope, time): two thirds of the rows on the hot scope, many on full hours."""
    rows = []
    for _ in range(count):
        scope = hot if rng.random() < 0.66 else rng.randrange(4)
        offset = timedelta(hours=rng.randrange(24 * 40))
        if rng.random() < 0.3:
            offset += timedelta(microseconds=rng.choice([1, 999_999, 1_800_000_000]))
        rows.append((scope, BASE + offset))
    return rows


@pytest.fixture(params=[1, 2, 3])
def lines(request):
    rng = random.Random(request.param)
    return moments(rng, 150, 0), moments(rng, 25, 0)


def frames(spark, probes, events):
    return (
        spark.createDataFrame(probes, "scope int, asked timestamp_ntz"),
        spark.createDataFrame(events, "scope int, happened timestamp_ntz"),
    )


@pytest.mark.parametrize("parts", ["1", "7"])
@pytest.mark.parametrize("within", [None, 3])
@pytest.mark.parametrize("scope", [["scope"], []])
def test_following_events(spark, lines, within, scope, parts):
    """Repeated probes, simultaneous events, a hot scope and lines cut into several partitions."""
    probes, events = lines
    probes = [(i, *p) for i, p in enumerate([*probes, *probes[:9], (None, BASE), (0, None)])]
    events = [(f"r{i * 7 % 11}", *e) for i, e in enumerate([*events, *events[:6], (None, BASE)])]
    asked = spark.createDataFrame(probes, "id int, scope int, asked timestamp_ntz")
    happened = spark.createDataFrame(events, "ref string, scope int, happened timestamp_ntz")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = following_events(
        asked, happened, scope=scope, at="asked", event_at="happened", ties=["ref"], within_days=within
    )
    rows = found.probes.join(found.events.select("event", "ref"), "event", "left").collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.enabled")
    expected = {}
    for i, s, at in probes:
        later = [(t, r) for r, e, t in events if at and t >= at and (not scope or (e == s and s is not None))]
        good = later and (within is None or min(later)[0] < at + timedelta(days=within))
        expected[i] = min(later) if good else (None, None)
    assert len(rows) == len(probes) and {r.id: (r.happened, r.ref) for r in rows} == expected


def test_events_before_is_strict(spark, lines):
    probes, events = lines
    df = events_before(*frames(spark, probes, events), scope=["scope"], at="asked", event_at="happened")
    expected = {(s, t): sum(e == s and h < t for e, h in events) for s, t in probes}
    assert {(r.scope, r.asked): r.events_before for r in df.collect()} == expected


@pytest.mark.parametrize("scope", [["scope"], []])
@pytest.mark.parametrize("window", [1, 10])
def test_pairs_by_whole_days(spark, lines, scope, window):
    probes, events = lines
    probes = probes + probes[:20] + [(0, None)]
    df = pairs_by_whole_days(
        *frames(spark, probes, events),
        scope=scope, at="asked", event_at="happened", window_days=window, day="d", count="n",
    )
    expected = Counter(
        (h - a) // timedelta(days=1)
        for s, a in probes if a is not None
        for e, h in events
        if (not scope or s == e) and a <= h < a + timedelta(days=window)
    )
    assert dict(df.collect()) == dict(expected)


def test_no_nested_loop_and_no_pairs(spark, lines):
    """Neither an all-pairs join nor a single-task sort of a whole scope's rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = frames(spark, *lines)
        for df in (
            following_events(*given, scope=["scope"], at="asked", event_at="happened").probes,
            pairs_by_whole_days(
                *given, scope=[], at="asked", event_at="happened", window_days=5, day="d", count="n"
            ),
        ):
            plan = plan_of(df)
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_without_events_nothing_is_found(spark):
    probes = spark.createDataFrame([(0, BASE)], "scope int, asked timestamp_ntz")
    none = spark.createDataFrame([], "scope int, happened timestamp_ntz")
    args = dict(scope=["scope"], at="asked", event_at="happened")
    assert [r.event for r in following_events(probes, none, **args).probes.collect()] == [None]
    assert [r.events_before for r in events_before(probes, none, **args).collect()] == [0]
    hist = pairs_by_whole_days(probes, none, **args, window_days=3, day="d", count="n")
    assert hist.count() == 0
    assert following_events(probes.filter(F.lit(False)), none, **args).probes.count() == 0

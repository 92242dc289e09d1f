"""Time lookups between two event tables without pairing their rows.

A range join on time would either compare everything with everything or emit every pair
inside a window. Both lookups here sort the two tables into one line per scope instead and
answer each distinct probe time from its position on that line.

The line is sorted over many tasks or cut into hours, so that one busy scope (an account
with a third of all rows, or the whole platform as a single scope) still spreads. What a
part of the line needs to know about the others is carried by one summary row per scope and part, which
makes a window over a whole scope safe there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.functions.dates import days
from kassenwerk.operators.numbering import ROW_BITS
from kassenwerk.session import written

_HOUR = ["_day", "_hour"]


def _on_line(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.to_date("_ts")).withColumn("_hour", F.hour("_ts"))


@dataclass(frozen=True)
class Following:
    """``probes`` with ``event_at`` and ``event`` (null where none follows); ``events`` by ``event``."""

    probes: DataFrame
    events: DataFrame


def following_events(
    probes: DataFrame,
    events: DataFrame,
    *,
    scope: Sequence[str],
    at: str,
    event_at: str,
    ties: Sequence[str] = (),
    within_days: int | None = None,
) -> Following:
    """Every probe row with the first event at or after its time in the same scope.

    Both tables are sorted once, as one line by scope and backwards in time, over as many tasks as Spark
    sees fit, and written. On the line the event that answers a probe is the last one before it:
    inside a partition that is a running maximum of the events' places, and where a
    scope goes on from an earlier partition, the last event of that one is carried over by a
    table with one row for each partition and scope it touches. However the scopes and times
    are spread, no task holds more than its part of the line.

    ``event`` numbers the events, later ones lower; of simultaneous ones that with the smallest
    ``ties`` counts. Only numbers travel with the probes: the events' other columns, ``ties``,
    are in ``events``. With ``within_days`` an event counts only if it lies before ``at`` plus that
    many days. Probes without time or scope are answered by none.
    """
    scope = list(scope)
    known = events.filter(F.col(event_at).isNotNull()).dropna(subset=scope) if scope else events.filter(F.col(event_at).isNotNull())
    happened = known.select(*scope, F.col(event_at).alias("_ts"), F.lit(0).alias("_probe"), *[F.col(c).alias(f"_event_{c}") for c in ties])
    asked = probes.withColumn("_ts", F.col(at)).withColumn("_probe", F.lit(1))
    backwards = [*scope, F.desc("_ts"), "_probe", *[F.desc(f"_event_{c}") for c in ties]]
    line = happened.unionByName(asked, allowMissingColumns=True).orderBy(*backwards)
    line = written(line.withColumn("_seq", F.monotonically_increasing_id()), "line").withColumn("_part", F.shiftright("_seq", ROW_BITS))

    here, place, moment = ["_part", *scope], F.when(F.col("_probe") == 0, F.col("_seq")), F.when(F.col("_probe") == 0, F.col("_ts"))
    so_far = Window.partitionBy(*here).orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        line.groupBy(*here)
        .agg(F.max(place).alias("_place"), F.min(moment).alias("_moment"))
        .select(
            F.col("_part").alias("_own_part"),
            *[F.col(c).alias(f"_own_{c}") for c in scope],
            F.max("_place").over(earlier).alias("_before"),
            F.min("_moment").over(earlier).alias("_before_at"),
        )
        .filter("_before IS NOT NULL")
    )
    same = reduce(lambda a, c: a & (F.col(c) == F.col(f"_own_{c}")), here[1:], F.col("_part") == F.col("_own_part"))
    found = line.withColumns({"_here": F.max(place).over(so_far), "_here_at": F.min(moment).over(so_far)}).filter("_probe = 1")
    found = found.join(carried, same, "left")
    event, time = F.coalesce("_here", "_before"), F.coalesce("_here_at", "_before_at")
    good = F.col(at).isNotNull()
    if within_days is not None:
        good = good & (time < F.col(at) + days(within_days))
    answered = found.select(*probes.columns, F.when(good, time).alias(event_at), F.when(good, event).alias("event"))
    told = line.filter("_probe = 0").select(F.col("_seq").alias("event"), *scope, F.col("_ts").alias(event_at), *[F.col(f"_event_{c}").alias(c) for c in ties])
    return Following(answered, told)


def events_before(
    probes: DataFrame, events: DataFrame, *, scope: Sequence[str], at: str, event_at: str
) -> DataFrame:
    """Number of events of the same scope strictly before each distinct probe time."""
    scope = list(scope)
    zero = F.lit(0).cast("bigint")
    asked = (
        probes.select(*scope, F.col(at).alias("_ts"))
        .distinct()
        .select("*", F.lit(0).alias("_event"), zero.alias("_n"))
    )
    counted = (
        events.groupBy(*scope, F.col(event_at).alias("_ts"))
        .agg(F.count("*").alias("_n"))
        .select(*scope, "_ts", F.lit(1).alias("_event"), "_n")
    )
    line = _on_line(asked.unionByName(counted))
    # At the same moment the probe comes first, so that it does not count that event.
    running = (
        Window.partitionBy(*scope, *_HOUR)
        .orderBy("_ts", "_event")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier_hours = (
        Window.partitionBy(*scope)
        .orderBy(*_HOUR)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    hours = (
        line.groupBy(*scope, *_HOUR)
        .agg(F.sum("_n").alias("_n_hour"))
        .withColumn("_earlier", F.coalesce(F.sum("_n_hour").over(earlier_hours), zero))
        .drop("_n_hour")
    )
    placed = line.withColumn("_here", F.sum("_n").over(running)).filter("_event = 0")
    return placed.join(hours, [*scope, *_HOUR], "left").select(
        *scope,
        F.col("_ts").alias(at),
        (F.col("_here") + F.coalesce("_earlier", zero)).alias("events_before"),
    )


def pairs_by_whole_days(
    starts: DataFrame,
    events: DataFrame,
    *,
    scope: Sequence[str],
    at: str,
    event_at: str,
    window_days: int,
    day: str,
    count: str,
) -> DataFrame:
    """Histogram of a bounded range join ``at <= event < at + window_days`` by whole days.

    Equals joining and grouping by the completed days between the two, but no pair is
    built. With C(x) events before x, a start at v has C(v + k+1 days) - C(v + k days)
    partners at distance k. Summed over all starts that is S(k+1) - S(k), where S(k) adds
    C(v + k days) over the starts. Each distinct start asks ``window_days + 1`` questions.
    """
    scope = list(scope)
    # Asked and weighed again below: one narrow table instead of two runs of what leads to it.
    weighted = written(starts.groupBy(*scope, at).agg(F.count("*").alias("_weight")), "starts")
    asked = weighted.filter(F.col(at).isNotNull()).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.lit(window_days)))
    ).withColumn("_at_k", F.col(at) + F.make_dt_interval("_k"))
    known = events_before(asked, events, scope=scope, at="_at_k", event_at=event_at)
    # Products of two row counts leave the range of a long at scale.
    wide: Column = F.col("_weight").cast("decimal(19,0)") * F.col("events_before").cast("decimal(19,0)")
    per_distance = (
        asked.join(known, [*scope, "_at_k"])
        .groupBy("_k")
        .agg(F.sum(wide).alias("_s"))
    )
    # At most window_days + 1 rows from here on.
    following = F.lead("_s").over(Window.orderBy("_k"))
    return (
        per_distance.select(
            F.col("_k").cast("bigint").alias(day),
            (following - F.col("_s")).cast("bigint").alias(count),
        )
        .filter(F.col(count) > 0)
    )

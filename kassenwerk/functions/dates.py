"""Report period arithmetic on timestamps without zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from kassenwerk.schema import STAMP

# Columns that cut stored tables into periods, and the unit that each holds the first day of.
PERIOD_COLUMNS = {"_day": "DAY", "_month": "MONTH"}


def stamp(moment: str | datetime) -> Column:
    return F.lit(str(moment)).cast(STAMP)


def days(count: int) -> Column:
    return F.make_dt_interval(F.lit(count))


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour units from ``start`` to ``end`` (not the number of midnights)."""
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def report_end_day(end: Column) -> Column:
    """Last day of a period given its end as text, inclusive or exclusive.

    ``23:59:59`` belongs to its own day, midnight to the day before; blank gives NULL.
    """
    moment = F.nullif(F.trim(end), F.lit("")).cast(STAMP)
    return F.to_date(moment - F.expr("INTERVAL '1' SECOND"))


def swiss_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")

"""Row filters of the reports. An empty selection matches nothing, never everything."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.functions.dates import PERIOD_COLUMNS, days, stamp
from kassenwerk.functions.text import digits_only
from kassenwerk.sources.tables import Tables

# States that count as revenue.
REPORTED_STATES = ("FULFILL", "COMPLETED")

Moment = str | datetime


def one_of(column: Column, wanted: Sequence) -> Column:
    if not wanted:
        return F.lit(False)
    if len(wanted) == 1:
        return column == F.lit(wanted[0])
    return column.isin(list(wanted))


def within(df: DataFrame, column: str, start: Moment, end: Moment, extra_days: int = 0) -> DataFrame:
    """Rows of a half-open window, ``extra_days`` beyond its end.

    Of a table that is stored by periods only the folders of the window's periods are read.
    """
    last = stamp(end) + days(extra_days) if extra_days else stamp(end)
    rows = df.filter((F.col(column) >= stamp(start)) & (F.col(column) < last))
    for name, unit in PERIOD_COLUMNS.items():
        if name in df.columns:
            first_day = lambda moment, unit=unit: F.to_date(F.date_trunc(unit, moment))
            rows = rows.filter(F.col(name).between(first_day(stamp(start)), first_day(last))).drop(name)
    return rows


def reported(state: Column) -> Column:
    return one_of(state, REPORTED_STATES)


def card_ends_with(masked_card: Column, typed: str) -> Column:
    """Suffix match on the digits of ``typed``; without any digit nothing matches."""
    digits = digits_only(typed)
    return masked_card.endswith(digits) if digits else F.lit(False)


def report_transactions(
    tables: Tables, spaces: Sequence[int] | None, start: Moment, end: Moment
) -> DataFrame:
    """Transactions a report is about; ``spaces=None`` means the report has no space filter."""
    rows = within(tables.transaction, "completedon", start, end).filter(reported(F.col("state")))
    return rows if spaces is None else rows.filter(one_of(rows.spaceid, spaces))


def at_terminals(tables: Tables, tx: DataFrame, terminals: Sequence[str]) -> DataFrame:
    """Keep transactions made at the named terminals, before anything is joined to them.

    The key side has at most as many rows as terminals were named (per space).
    """
    keys = tables.paymentterminal.filter(one_of(F.col("identifier"), terminals)).select(
        F.col("id").alias("terminal_id"), "spaceid"
    )
    return tx.join(keys, ["terminal_id", "spaceid"], "left_semi")

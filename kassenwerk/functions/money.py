"""Reading, rounding and printing exact amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kassenwerk.schema import TOTAL

READ = "decimal(38,8)"
PLAIN_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"


def read_amount(text: Column) -> Column:
    """Decimal text as an exact amount; text that is no plain number, or none, counts as zero.

    A plain number always counts: one of more than 30 digits before the point stops the
    query (or is null without ANSI mode) instead of passing for zero.
    """
    plain = F.trim(text)
    return F.when(plain.rlike(PLAIN_NUMBER), plain.cast(READ)).otherwise(F.lit(0).cast(READ))


def read_count(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def total(amount: Column) -> Column:
    return F.sum(amount).cast(TOTAL)


def total_or_zero(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL)


def two_places(amount: Column) -> Column:
    """Half-up to two decimals, symmetric around zero."""
    return F.round(amount, 2).cast("decimal(38,2)")


def plain_amount(amount: Column) -> Column:
    """Machine-readable text: point, no grouping, no trailing zeros (``29.7``, ``30``)."""
    return F.regexp_replace(two_places(amount).cast("string"), r"\.?0+$", "")


def swiss_amount(amount: Column) -> Column:
    """Two decimals with U+2019 between thousands (``1’436.70``)."""
    return F.translate(F.format_number(two_places(amount), 2), ",", "’")


def swiss_integer(number: Column) -> Column:
    return F.translate(F.format_number(number.cast("bigint"), 0), ",", "’")

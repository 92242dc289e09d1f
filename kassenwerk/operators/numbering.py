"""Consecutive numbers inside groups that may be far too big for one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.session import written

# monotonically_increasing_id keeps the partition in the bits above this one.
ROW_BITS = 33


def number_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], number: str = "nr"
) -> DataFrame:
    """Number the rows of each group 1..n in the given order.

    A ``row_number`` window would pull a whole group into one task, and a single group can
    hold a third of the table. Here the table is range-sorted by group and order, so a big
    group lies on several consecutive partitions; a row's number is its position in its
    partition plus the group's rows on earlier partitions. The sorted rows are written
    once, so that position and partition cannot change between the two passes over them.
    """
    groups = list(groups)
    placed = written(
        df.orderBy(*groups, *order).withColumn("_seq", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_seq", ROW_BITS))
    earlier = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per group and partition it touches.
    pieces = placed.groupBy(*groups, "_part").agg(
        F.count("*").alias("_n"), F.min("_seq").alias("_first")
    )
    offsets = pieces.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    ).select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("__part"), "_offset")
    matches = reduce(
        lambda found, g: found & F.col(g).eqNullSafe(F.col(f"_{g}")),
        groups,
        F.col("_part") == F.col("__part"),
    )
    return placed.join(offsets, matches).select(
        *df.columns, (F.col("_seq") + F.col("_offset")).alias(number)
    )

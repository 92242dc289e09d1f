"""Terminal report: outlet groups, brand groups and totals on every level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.functions.money import total_or_zero
from kassenwerk.functions.text import (
    DEFAULT_BRAND_GROUP,
    blank_to_null,
    brand_group,
    outlet_group,
)

# Level names, from the finest to the grand total.
DETAIL, OUTLET, BRAND_GROUP, GRAND = "detail", "outlet", "brand_group", "grand_total"

_FINE = ["outlet", "brand_group", "tid", "name", "brand"]


def merged_outlets(rows: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Outlet per terminal of ``rows``: the saved name unless blank, else the name rule.

    ``saved`` has (terminal_identifier, outlet); entries of vanished terminals drop out.
    """
    found = rows.groupBy("terminal_identifier").agg(F.min("terminal_name").alias("terminal_name"))
    return _merged(found, saved, "terminal_identifier", "outlet", outlet_group(F.col("terminal_name")))


def merged_brand_groups(
    rows: DataFrame, saved: DataFrame | None = None, default: str = DEFAULT_BRAND_GROUP
) -> DataFrame:
    """Brand group per brand of ``rows``; ``saved`` has (brand, brand_group)."""
    found = rows.select("brand").distinct()
    return _merged(found, saved, "brand", "brand_group", brand_group(F.col("brand"), default))


def _unique(mapping: DataFrame, key: str, group: str, name: str) -> DataFrame:
    """One row per key, the smallest name that is not blank: a repeated entry doubles no money."""
    return mapping.groupBy(key).agg(F.min(blank_to_null(F.col(group))).alias(name))


def _merged(
    found: DataFrame, saved: DataFrame | None, key: str, group: str, rule: Column
) -> DataFrame:
    if saved is None:
        return found.select(key, rule.alias(group))
    return found.join(_unique(saved, key, group, "_saved"), key, "left").select(
        key, F.coalesce(blank_to_null(F.col("_saved")), rule).alias(group)
    )


def grouped_rows(
    rows: DataFrame,
    outlets: DataFrame | None = None,
    brand_groups: DataFrame | None = None,
    default_brand_group: str = DEFAULT_BRAND_GROUP,
) -> DataFrame:
    """Terminal report rows with their outlet and brand group.

    ``outlets`` and ``brand_groups`` are mappings as above; what they do not name, or name
    blank, follows the rule. Groups merge by name.
    """
    for mapping, key, saved in ((outlets, "terminal_identifier", "outlet"),
                                (brand_groups, "brand", "brand_group")):
        if mapping is None:
            rows = rows.withColumn(f"_saved_{saved}", F.lit(None).cast("string"))
        else:
            rows = rows.join(_unique(mapping, key, saved, f"_saved_{saved}"), key, "left")
    return rows.select(
        F.coalesce(
            blank_to_null(F.col("_saved_outlet")), outlet_group(F.col("terminal_name"))
        ).alias("outlet"),
        F.coalesce(
            blank_to_null(F.col("_saved_brand_group")),
            brand_group(F.col("brand"), default_brand_group),
        ).alias("brand_group"),
        F.col("terminal_identifier").alias("tid"),
        F.col("terminal_name").alias("name"),
        "brand",
        F.col("waehrung"),
        F.col("brutto_gross").alias("gross"),
        F.col("tip_total").alias("tip"),
        F.col("unsettled_anzahl").alias("unmatched"),
        F.col("anzahl_transaktionen").alias("count"),
    )


def terminal_group_report(
    rows: DataFrame,
    outlets: DataFrame | None = None,
    brand_groups: DataFrame | None = None,
    default_brand_group: str = DEFAULT_BRAND_GROUP,
    by_currency: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """All totals in one pass: terminal and brand, outlet, brand group, grand total.

    Amounts of different currencies are never added: the currency is part of every level.
    With ``by_currency=False`` the input is taken as one currency, and the grand total is
    present (zero) even without any row.
    """
    grouped = grouped_rows(rows, outlets, brand_groups, default_brand_group)
    fixed = ["waehrung"] if by_currency else []
    if not by_currency:
        grouped = grouped.withColumn("_real", F.lit(1)).unionByName(
            grouped.sparkSession.range(1).select(F.lit(0).alias("_real")), allowMissingColumns=True
        )
    else:
        grouped = grouped.withColumn("_real", F.lit(1))
    sets = [_FINE, ["outlet", "brand_group"], ["brand_group"], []]
    keys = [*fixed, *_FINE]
    totals = grouped.groupingSets(
        [[F.col(c) for c in [*fixed, *level]] for level in sets], *[F.col(c) for c in keys]
    ).agg(
        F.grouping("tid").alias("_no_terminal"),
        F.grouping("outlet").alias("_no_outlet"),
        F.grouping("brand_group").alias("_no_group"),
        total_or_zero(F.col("gross")).alias("complete_demand"),
        total_or_zero(F.col("tip")).alias("tip"),
        F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"),
        F.max("_real").alias("_real"),
    )
    level = (
        F.when(F.col("_no_terminal") == 0, DETAIL)
        .when(F.col("_no_outlet") == 0, OUTLET)
        .when(F.col("_no_group") == 0, BRAND_GROUP)
        .otherwise(GRAND)
    )
    report = (
        totals.withColumn("level", level)
        .filter((F.col("_real") == 1) | (F.col("level") == GRAND))
        .select(
            "level", *keys, "complete_demand", "tip", "unmatched", "count"
        )
    )
    if not ordered:
        return report
    german = [F.collate(c, "de") for c in ("outlet", "brand_group", "name")]
    return report.orderBy(level_order(F.col("level")), *fixed, *german, "tid", "brand")


def terminals_with_brands(
    rows: DataFrame,
    outlets: DataFrame | None = None,
    brand_groups: DataFrame | None = None,
    default_brand_group: str = DEFAULT_BRAND_GROUP,
    by_currency: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """One row per outlet and terminal, with its totals and its brands in German order.

    A terminal with several brands is one row, however often it was renamed (its smallest name
    counts); ``brands`` has brand, brand_group and the measures of each. Groups and currencies are as in the
    grouped report, whose detail level holds the same amounts.
    """
    grouped = grouped_rows(rows, outlets, brand_groups, default_brand_group)
    fixed = ["waehrung"] if by_currency else []
    whole = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    measures = lambda gross: [
        total_or_zero(F.col(gross)).alias("complete_demand"), total_or_zero(F.col("tip")).alias("tip"), whole("unmatched"), whole("count"),
    ]
    by_brand = grouped.groupBy(*fixed, "outlet", "tid", "brand_group", "brand").agg(F.min("name").alias("name"), *measures("gross"))
    # As many brands as a terminal has: a few.
    named = F.struct(F.collate(F.col("brand"), "de").alias("_order"), "brand", "brand_group", "complete_demand", "tip", "unmatched", "count")
    nested = by_brand.groupBy(*fixed, "outlet", "tid").agg(
        F.min("name").alias("name"), *measures("complete_demand"), F.sort_array(F.collect_list(named)).alias("brands")
    )
    brands = F.transform("brands", lambda b: b.dropFields("_order"))
    report = nested.select(*fixed, "outlet", "tid", "name", "complete_demand", "tip", "unmatched", "count", brands.alias("brands"))
    if not ordered:
        return report
    return report.orderBy(*fixed, F.collate("outlet", "de"), F.collate("name", "de"), "tid")


def level_order(level: Column) -> Column:
    """Outlet totals, brand group totals, grand total, detail - the order of the blocks."""
    return (
        F.when(level == OUTLET, 1).when(level == BRAND_GROUP, 2).when(level == GRAND, 3).otherwise(4)
    )

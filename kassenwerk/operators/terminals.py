"""Upkeep of the stored terminal list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.functions.text import belongs_to_space, blank_to_null
from kassenwerk.session import written
from kassenwerk.sources.versioned import VersionedTable

# What happened to a terminal.
NEW, UPDATED, KEPT = "new", "updated", "kept"


def upsert_terminals(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge delivered terminals into the stored list.

    ``stored``: id, label, selected, space, space_id. ``incoming``: seq, identifier, name,
    space, space_id. Of several deliveries of one identifier the first counts; blank
    identifiers are skipped. New terminals come in selected, with the identifier as label
    if they have no name. Known ones keep their selection and take over what is not blank.
    ``change`` says what happened, ``seq`` keeps the order of arrival for new ones.
    """
    first = (
        incoming.filter(blank_to_null(F.col("identifier")).isNotNull())
        .groupBy("identifier")
        .agg(F.min_by(F.struct("name", "space", "space_id", "seq"), "seq").alias("delivered"))
    )
    known = stored.select(F.struct(*stored.columns).alias("old"))
    both = known.join(first, F.col("old.id") == F.col("identifier"), "full_outer")

    def taken_over(field: str, delivered: str) -> Column:
        return F.coalesce(blank_to_null(F.col(f"delivered.{delivered}")), F.col(f"old.{field}"))

    is_new = F.col("old").isNull()
    updated = {
        "label": taken_over("label", "name"),
        "space": taken_over("space", "space"),
        "space_id": taken_over("space_id", "space_id"),
    }
    differs = F.lit(False)
    for field, value in updated.items():
        differs = differs | ~value.eqNullSafe(F.col(f"old.{field}"))
    return both.select(
        F.coalesce("old.id", "identifier").alias("id"),
        F.when(is_new, F.coalesce(updated["label"], "identifier"))
        .otherwise(updated["label"])
        .alias("label"),
        F.coalesce("old.selected", F.lit(True)).alias("selected"),
        F.when(is_new, F.coalesce(updated["space"], F.lit("")))
        .otherwise(updated["space"])
        .alias("space"),
        F.when(is_new, F.coalesce(updated["space_id"], F.lit("")))
        .otherwise(updated["space_id"])
        .alias("space_id"),
        F.when(is_new, NEW).when(differs, UPDATED).otherwise(KEPT).alias("change"),
        F.when(is_new, F.col("delivered.seq")).alias("seq"),
    )


def upsert_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("change") == NEW).alias("neu"),
        F.count_if(F.col("change") == UPDATED).alias("aktualisiert"),
    )


def select_for_space(terminals: DataFrame, space_id: str | int | None, selected: bool) -> DataFrame:
    """Set the selection of one space's terminals; ``changed`` marks real changes only."""
    wanted = F.lit(None if space_id is None else str(space_id)).cast("string")
    own = belongs_to_space(F.col("space_id"), F.col("space"), wanted)
    return terminals.withColumns(
        {
            "changed": own & (F.col("selected") != F.lit(selected)),
            "selected": F.when(own, F.lit(selected)).otherwise(F.col("selected")),
        }
    )


def changed_count(terminals: DataFrame) -> DataFrame:
    return terminals.agg(F.count_if("changed").alias("geaendert"))


STORED = "id string, label string, selected boolean, space string, space_id string"


def save_delivery(stored: VersionedTable, delivered: DataFrame, operation: str) -> DataFrame:
    """Merge a delivery into the stored list for good, and say how many terminals are new and updated.

    A delivery that is saved again under the same name of its operation changes nothing.
    """
    read = stored.current()
    if operation in read.operations:
        return upsert_counts(stored.rows(read).limit(0).withColumn("change", F.lit(KEPT)))
    merged = written(upsert_terminals(stored.rows(read), delivered), "merged")
    stored.replace(merged, read, operation)
    return upsert_counts(merged)


def save_selection(stored: VersionedTable, space_id: str | int | None, selected: bool, operation: str) -> DataFrame:
    """Set the selection of one space's terminals for good; a version is written only if any changes."""
    read = stored.current()
    if operation in read.operations:
        return changed_count(stored.rows(read).limit(0).withColumn("changed", F.lit(False)))
    chosen = written(select_for_space(stored.rows(read), space_id, selected), "selected")
    if not chosen.filter("changed").isEmpty():
        stored.replace(chosen, read, operation)
    return changed_count(chosen)

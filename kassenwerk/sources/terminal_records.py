"""Terminal records delivered as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = "identifier string, name string, id string, state string"


def terminal_records(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """identifier, name, id and state of each record.

    Missing text becomes empty, an id that is not a number becomes NULL, and text that is
    no JSON object counts as a record without any field.
    """
    record = F.from_json(F.col(column), _FIELDS)
    return json_rows.select(record.alias("r")).select(
        F.coalesce("r.identifier", F.lit("")).alias("identifier"),
        F.coalesce("r.name", F.lit("")).alias("name"),
        F.trim("r.id").try_cast("bigint").alias("id"),
        F.coalesce("r.state", F.lit("")).alias("state"),
    )

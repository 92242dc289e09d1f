"""Report rows from CSV results. Columns are found by header name, in any order.

A result that lacks columns is reported, not raised: the rows are empty then and the
error lists what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassenwerk.functions.money import read_amount, read_count
from kassenwerk.functions.text import blank_to_null
from kassenwerk.schema import SETTLEMENT_ROW, TERMINAL_ROW
from kassenwerk.sources import csv_records

# The two names of the counter column and the optional columns' defaults.
COUNTER_NAMES = ("unmatched_anzahl", "unsettled_anzahl")
TERMINAL_REQUIRED = (
    "terminal_identifier", "terminal_name", "brand", "brutto_gross", "tip_total",
)
DEFAULT_CURRENCY = "CHF"
MALFORMED = "_malformed"
NO_RECORD, UNKNOWN = "NO_RECORD", "UNKNOWN"


@dataclass(frozen=True)
class CsvError:
    message: str
    missing: tuple[str, ...] = ()


@dataclass(frozen=True)
class CsvRows:
    """``malformed`` holds the text of rows whose width is not the header's; they are not in ``rows``."""

    rows: DataFrame
    error: CsvError | None = None
    malformed: DataFrame | None = None


def _apart(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    # A text column takes part in the test, since the mark alone cannot be asked for.
    first = F.coalesce(F.col(raw.columns[0]), F.lit(""))
    bad = F.length(F.concat(first, F.coalesce(F.col(MALFORMED), F.lit("")))) > F.length(first)
    return raw.filter(~bad), raw.filter(bad).select(raw.columns[0], F.col(MALFORMED).alias("line")).select("line")


def _split_rows(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """The records behind each file's header as columns ``names`` and ``MALFORMED``; an unquoted empty cell is null."""
    found = csv_records.records(spark, path).withColumn("cells", csv_records.raw_cells(F.col("record")))
    own = F.transform("cells", csv_records.unquoted)
    message = F.concat(F.lit("CSV header does not conform to the first file's: "), F.array_join(own, ","), F.lit(" in "), F.col("file"))
    is_header = F.when(own == F.array(*map(F.lit, names)), F.lit(True)).otherwise(F.raise_error(message))
    rows = found.filter(~F.when((F.col("block") == 0) & (F.col("nr") == 1), is_header).otherwise(F.lit(False)))
    cell = lambda i: F.when(F.get("cells", F.lit(i)) != "", csv_records.unquoted(F.get("cells", F.lit(i))))
    bad = F.when(F.size("cells") != len(names), F.col("record"))
    return rows.select(*[cell(i).alias(n) for i, n in enumerate(names)], bad.alias(MALFORMED))


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column as text. Files with another header order are refused.

    Files are split in any case. ``multi_line`` allows line breaks inside quotes: if a line
    with an odd number of quotes tells that there are any, records are cut by the parity scan of
    ``csv_records``; otherwise Spark's reader splits at lines. Without it files are taken to
    have no such breaks, which saves the look at all lines.
    A row with more or fewer cells than the header carries its text in ``MALFORMED``.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    names = reader.option("multiLine", multi_line).csv(path).columns
    if not names:
        return reader.csv(path)
    if multi_line and csv_records.has_broken_lines(spark, path):
        return _split_rows(spark, path, names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
    # With pruned columns a row would only be as wide as what is asked for, and none malformed.
    whole_lines = reader.option("multiLine", False).option("columnPruning", False).schema(schema)
    return whole_lines.option("columnNameOfCorruptRecord", MALFORMED).csv(path)


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV as rows of cells, the header being the first row of its file.

    Every row keeps its own width, so files of stacked tables lose nothing. ``file``, ``block``
    and ``nr`` tell the rows' order. Files are split, also where quotes hold line breaks.
    """
    cells = F.transform(csv_records.raw_cells(F.col("record")), csv_records.unquoted)
    return csv_records.records(spark, path).select("file", "block", "nr", cells.alias("cells"))


def _failed(spark: SparkSession, schema: T.StructType, error: CsvError) -> CsvRows:
    return CsvRows(spark.createDataFrame([], schema), error)


def _checked(
    spark: SparkSession, raw: DataFrame, schema: T.StructType, missing: Sequence[str]
) -> CsvRows | None:
    if not raw.columns:
        return _failed(spark, schema, CsvError("Die CSV ist leer."))
    if missing:
        message = f"Pflichtspalten fehlen: {', '.join(missing)}"
        return _failed(spark, schema, CsvError(message, tuple(missing)))
    return None


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_terminal_csv(spark: SparkSession, path: str, multi_line: bool = True) -> CsvRows:
    """Terminal report rows; the unsettled counter is accepted under either of its names."""
    raw = read_csv_text(spark, path, multi_line)
    counter = next((name for name in COUNTER_NAMES if name in raw.columns), None)
    missing = [name for name in TERMINAL_REQUIRED if name not in raw.columns]
    if counter is None:
        missing.append(" / ".join(COUNTER_NAMES))
    failure = _checked(spark, raw, TERMINAL_ROW, missing)
    if failure is not None:
        return failure
    good, bad = _apart(raw)
    has_count, has_currency = ("anzahl_transaktionen" in raw.columns, "waehrung" in raw.columns)
    currency = blank_to_null(F.col("waehrung")) if has_currency else F.lit(None)
    return CsvRows(
        malformed=bad,
        rows=good.select(
            _text("terminal_identifier").alias("terminal_identifier"),
            _text("terminal_name").alias("terminal_name"),
            _text("brand").alias("brand"),
            F.coalesce(currency, F.lit(DEFAULT_CURRENCY)).alias("waehrung"),
            (
                read_count(F.col("anzahl_transaktionen"))
                if has_count
                else F.lit(0).cast("bigint")
            ).alias("anzahl_transaktionen"),
            read_count(F.col(counter)).alias("unsettled_anzahl"),
            read_amount(F.col("brutto_gross")).alias("brutto_gross"),
            read_amount(F.col("tip_total")).alias("tip_total"),
        )
    )


def read_settlement_csv(spark: SparkSession, path: str, multi_line: bool = True) -> CsvRows:
    """Settlement rows; all fourteen columns are required, most cells may be blank."""
    raw = read_csv_text(spark, path, multi_line)
    missing = [name for name in SETTLEMENT_ROW.names if name not in raw.columns]
    failure = _checked(spark, raw, SETTLEMENT_ROW, missing)
    if failure is not None:
        return failure
    amounts = ("brutto_gross", "settlement_gross", "processing_fees", "netamount")
    texts = ("transaction_id", "merchant_reference", "terminal_identifier", "sales_channel", "waehrung")
    value = {
        "settlement_datum": F.trim(F.col("settlement_datum")).try_cast("date"),
        "settlement_state": F.coalesce(blank_to_null(F.col("settlement_state")), F.lit(NO_RECORD)),
        "connector": F.coalesce(blank_to_null(F.col("connector")), F.lit(UNKNOWN)),
        "space_id": F.trim(F.col("space_id")).try_cast("bigint"),
        "settlement_records": read_count(F.col("settlement_records")),
        **{name: _text(name) for name in texts},
        **{name: read_amount(F.col(name)) for name in amounts},
    }
    good, bad = _apart(raw)
    return CsvRows(good.select(*[value[name].alias(name) for name in SETTLEMENT_ROW.names]), malformed=bad)

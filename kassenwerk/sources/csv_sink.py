"""Writing raw results and report blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.plans.blocks import HEADER, in_block_order

# Fixed values of the report file.
BOM = "\ufeff"
SEPARATOR = ";"
LINE_END = "\r\n"

BLOCK_COLUMNS = ("block_no", "block", "row_no", "kind", "cells", "types", "note", "alignment")


def write_result_csv(df: DataFrame, path: str) -> None:
    """Raw result as comma-separated files with a header, one file per task."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def csv_field(cell: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[;"\r\n]'), quoted).otherwise(cell)


def csv_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, csv_field), SEPARATOR)


def report_lines(blocks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Text lines of the report in order: title, header and rows of each block.

    A block's remark follows its title on a line of its own; blocks are set apart by an
    empty line. The mark for UTF-8 opens the first title.
    """
    first = F.col("block_no") == 1
    title = F.concat(F.when(first, F.lit(BOM)).otherwise(""), csv_field(F.col("block")))
    above = F.filter(
        F.array(
            F.when(~first, F.lit("")),
            title,
            F.nullif(csv_field(F.col("note")), F.lit("")),
        ),
        lambda line: line.isNotNull(),
    )
    lines = F.when(
        F.col("kind") == HEADER, F.concat(above, F.array(csv_line(F.col("cells"))))
    ).otherwise(F.array(csv_line(F.col("cells"))))
    return in_block_order(blocks, scope).select(
        *scope, "block_no", "row_no", F.posexplode(lines).alias("line_no", "line")
    )


def write_report_csv(blocks: DataFrame, path: str, scope: Sequence[str] = ()) -> None:
    """Sorted text files whose concatenation in name order is the report file.

    A report without detail is small and ends up as one file; a detailed one stays spread
    over many tasks. ``scope`` names the columns by which the blocks are split: each of their
    values has a report file in a folder of its own. Blocks split by others are refused.
    """
    other = [
        c for c in blocks.columns
        if c not in (*BLOCK_COLUMNS, *scope) and not c.startswith("sort_")
    ]
    if other:
        raise ValueError(f"the blocks are split by {', '.join(other)}; name these columns as scope")
    writer = report_lines(blocks, scope).select(*scope, "line").write.option("lineSep", LINE_END)
    (writer.partitionBy(*scope) if scope else writer).text(path)

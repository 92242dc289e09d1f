"""CSV records of files of any size, with line breaks inside quotes, read by many tasks.

Spark's own reader gives a file with quoted line breaks to a single task, because a split
alone cannot tell whether its first line begins inside quotes. Here a *quote-parity prefix scan*
tells it: every split reports how many quotes it holds, and the sum over a file's earlier
splits, modulo two, says how it begins. Then each split is cut by itself: a line that begins
outside quotes begins a record. What a split's first record lacks at its front, and its last one
at its end, are pieces; of these there are at most two for each split, and they are put together
by the order of the splits.

Quotes stand around whole cells and are doubled inside them. Records end with a line feed, with or without a
carriage return before it; line breaks inside quotes stay as they are. A quote that is
never closed takes the rest of its file. Empty lines outside quotes are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kassenwerk.session import written

BOM = "\ufeff"
SPLIT = ["file", "block"]
# A cell with the comma before it; the record is read with a comma put before its first cell.
CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their split (file and first byte) and a number that ascends within it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        _quotes(F.col("value")).alias("quotes"),
    )


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether any record goes over several lines; if not, a file can be split at every line."""
    return not _lines(spark, path).filter("quotes % 2 = 1").isEmpty()


def beginnings(lines: DataFrame) -> DataFrame:
    """Of every split, 1 if its first line begins inside quotes, else 0, as ``inside``."""
    splits = lines.groupBy(*SPLIT).agg((F.sum("quotes") % 2).alias("odd"))
    # One row for each split from here on.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(*SPLIT, (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("inside"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``nr`` (ascending in a file) and ``record``, the text between record ends.

    The lines move once, to their split's task. Only records of several lines are put together
    from rows; all others are lines already.
    """
    lines = _lines(spark, path)
    in_split = Window.partitionBy(*SPLIT).orderBy("line")
    before = F.coalesce(F.sum("quotes").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.join(beginnings(lines), SPLIT).withColumn("inside", (F.col("inside") + before) % 2 == 1)
    begun = begun.filter(F.col("inside") | (F.rtrim(F.col("value"), F.lit("\r")) != ""))
    starts = F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = begun.withColumn("nr", starts)

    odd = F.col("quotes") % 2 == 1
    single = numbered.filter(~F.col("inside") & ~odd).select(*SPLIT, "nr", F.col("value").alias("record"))
    text = lambda rows, part: F.array_join(F.transform(rows, lambda r: r[part]), "\n")
    parts = written(
        numbered.filter(F.col("inside") | odd)
        .groupBy(*SPLIT, "nr")
        .agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("rows"), (F.sum("quotes") % 2 == 1).alias("open"))
        .select(*SPLIT, "nr", text(F.col("rows"), "value").alias("record"), (F.col("open") | (F.col("nr") == 0)).alias("piece")),
        "csv-parts",
    )
    # A piece with number 0 goes on with the record that was open before its split.
    so_far = Window.partitionBy("file").orderBy("block", "nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = parts.filter("piece").withColumn("chain", F.count_if(F.col("nr") > 0).over(so_far))
    joined = chained.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "nr", "record"))).alias("rows"))
    first = F.col("rows")[0]
    joined = joined.select("file", first["block"].alias("block"), first["nr"].alias("nr"), text(F.col("rows"), "record").alias("record"))

    every = single.unionByName(parts.filter("NOT piece").drop("piece")).unionByName(joined)
    marked = (F.col("block") == 0) & (F.col("nr") == 1) & F.startswith(F.col("record"), F.lit(BOM))
    bare = F.when(marked, F.substring("record", 2, 2**31 - 1)).otherwise(F.col("record"))
    return every.select(*SPLIT, "nr", F.regexp_replace(bare, r"\r\z", "").alias("record"))


def raw_cells(record: Column) -> Column:
    """The cells of a record as they are written, quotes included."""
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CELL), F.lit(1))


def unquoted(cell: Column) -> Column:
    return F.when(
        F.startswith(cell, F.lit('"')), F.replace(F.substring(cell, 2, F.length(cell) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(cell)

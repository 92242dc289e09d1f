"""The payment tables stored the way the reports read them.

Tables with a time are cut into days or months of it, so that a report's period prunes folders
before any file is opened. Fact tables are bucketed by the transaction they belong to, all into the same
number of buckets: joins and aggregates on a transaction's id then read matching buckets and
move no row. Tables that are joined by another id are bucketed by that, which spares their
side of the shuffle. Small tables are stored plainly.

Rows are dealt out by bucket before they are written, so every task writes one file per bucket and
period it holds. A bucket is written, and later read, by one task: their number has to come from the rows
(``buckets_for``), or that task's part would grow with the tables. What dealt a table out is dropped
once the table is stored, so that the disk holds the stored tables and one table's shuffle, and the largest
shuffle comes while least is stored. Files are packed densely: most of them are long ids in order, of which delta
encoding keeps what differs.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassenwerk.functions.dates import PERIOD_COLUMNS
from kassenwerk.schema import TABLES
from kassenwerk.session import dropping_shuffles, estimated_bytes
from kassenwerk.sources.tables import Tables

DAY, MONTH = PERIOD_COLUMNS
NOTE = "_layout"
# Some 50 to 60 bytes each in a shuffle, which makes a bucket about a shuffle partition of the usual size.
ROWS_PER_BUCKET = 2_000_000
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}


@dataclass(frozen=True)
class Stored:
    """``time`` cuts the table into periods, ``bucket`` are the columns it is bucketed by."""

    time: str | None = None
    bucket: tuple[str, ...] = ()


STORED = {
    "transaction": Stored("completedon", ("id",)),
    "charge": Stored(bucket=("transaction_id",)),
    "payfacsettlementrecord": Stored(bucket=("transaction_id",)),
    "transaction_lineitem": Stored(bucket=("transaction_id",)),
    "chargeattempt": Stored(bucket=("charge_id",)),
    "banktransaction": Stored(bucket=("id",)),
    "lineitem": Stored(bucket=("id", "spaceid")),
    "currentaccountwithdrawal": Stored("createdon"),
}


def _columns(name: str, period: str) -> list[str]:
    return [*TABLES[name].names, *([period] if STORED.get(name, Stored()).time else [])]


def _stored(spark: SparkSession, database: str) -> Tables:
    tables = Tables.from_catalog(spark, database)
    tables.by_transaction = True
    return tables


def buckets_for(tables: Tables, minimum: int = 8) -> int:
    """Number of buckets under which none of the largest table holds much more than ``ROWS_PER_BUCKET`` rows.

    The rows are counted, one scan without columns a table: Spark's estimate of bytes knows neither
    what a filter drops nor how long a text is. Spark's own limit of buckets holds.
    """
    spark = tables.transaction.sparkSession
    most = max(tables[name].count() for name, how in STORED.items() if how.bucket)
    limit = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(limit, max(minimum, math.ceil(most / ROWS_PER_BUCKET)))


def _largest_first(tables: Tables) -> list[str]:
    return sorted(TABLES, key=lambda name: estimated_bytes(tables[name]), reverse=True)


def write_tables(tables: Tables, database: str, root: str, buckets: int, period: str = DAY) -> Tables:
    """Store all tables below ``root`` and name them in ``database``; the stored tables are returned.

    ``buckets`` should make a bucket of the largest table what one task can read, see ``buckets_for``.
    """
    if period not in PERIOD_COLUMNS:
        raise ValueError(f"period must be one of {', '.join(PERIOD_COLUMNS)}")
    spark = tables.transaction.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name in _largest_first(tables):
        df, how = tables[name].select(*TABLES[name].names), STORED.get(name, Stored())
        if how.time:
            df = df.withColumn(period, F.to_date(F.date_trunc(PERIOD_COLUMNS[period], how.time)))
        if how.bucket:
            df = df.repartition(buckets, *how.bucket)
        elif how.time:
            df = df.repartition(period)
        writer = df.write.format("parquet").options(**PACKED).option("path", f"{root}/{name}")
        if how.time:
            writer = writer.partitionBy(period)
        if how.bucket:
            writer = writer.bucketBy(buckets, *how.bucket).sortBy(*how.bucket)
        with dropping_shuffles(spark):
            writer.saveAsTable(f"`{database}`.`{name}`")
    note = json.dumps({"buckets": buckets, "period": period})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{root}/{NOTE}")
    return _stored(spark, database)


def open_tables(spark: SparkSession, database: str, root: str) -> Tables:
    """Name tables that another session stored below ``root`` in this session's ``database``."""
    note = json.loads(spark.read.text(f"{root}/{NOTE}").first().value)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, schema in TABLES.items():
        how = STORED.get(name, Stored())
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
        if how.time:
            columns.append(f"`{note['period']}` date")
        parts = [f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({', '.join(columns)}) USING parquet"]
        if how.time:
            parts.append(f"PARTITIONED BY (`{note['period']}`)")
        if how.bucket:
            by = ", ".join(f"`{c}`" for c in how.bucket)
            parts.append(f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {note['buckets']} BUCKETS")
        spark.sql(" ".join([*parts, f"LOCATION '{root}/{name}'"]))
        if how.time:
            spark.sql(f"ALTER TABLE `{database}`.`{name}` RECOVER PARTITIONS")
    return _stored(spark, database)


def plain(df: DataFrame) -> DataFrame:
    """Without the column that cuts a stored table into periods."""
    return df.drop(*PERIOD_COLUMNS)

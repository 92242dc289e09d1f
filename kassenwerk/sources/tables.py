"""The twelve payment tables as one bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassenwerk.schema import TABLES


class Tables:
    """Payment tables by name; a table is opened when a query first asks for it."""

    transaction: DataFrame
    paymentconnectorconfiguration: DataFrame
    paymentconnector: DataFrame
    paymentterminal: DataFrame
    charge: DataFrame
    chargeattempt: DataFrame
    payfacsettlementrecord: DataFrame
    banktransaction: DataFrame
    currentaccountwithdrawal: DataFrame
    spacereference: DataFrame
    transaction_lineitem: DataFrame
    lineitem: DataFrame

    # Whether the fact tables are bucketed by their transaction, so that a cut to a report's transactions moves no row.
    by_transaction = False

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]) -> None:
        if openers.keys() != TABLES.keys():
            raise ValueError(f"tables must be exactly {', '.join(TABLES)}")
        self._openers = dict(openers)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        opened = self._openers[name]()
        setattr(self, name, opened)
        return opened

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Tables:
        """One parquet table per name under ``root``; the declared schema is used as is."""
        return cls(
            {
                name: lambda name=name: spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
                for name in TABLES
            }
        )

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Tables:
        return cls(
            {name: lambda name=name: spark.table(f"`{database}`.`{name}`") for name in TABLES}
        )

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> Tables:
        """Bundle the given frames; tables not given are empty but keep their schema."""
        return cls(
            {
                name: lambda name=name: (
                    frames[name]
                    if name in frames
                    else spark.createDataFrame([], TABLES[name])
                )
                for name in TABLES
            }
        )


def table_columns(df: DataFrame) -> DataFrame:
    """Column names and types of a table in ordinal order."""
    spark = df.sparkSession
    listed = [
        (position, field.name, field.dataType.simpleString())
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return (
        spark.createDataFrame(
            listed, "ordinal_position int, column_name string, data_type string"
        )
        .orderBy("ordinal_position")
        .select(F.col("column_name"), F.col("data_type"), F.col("ordinal_position"))
    )

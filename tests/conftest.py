import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kassenwerk.schema import SETTLEMENT_ROW, TABLES, TERMINAL_ROW
from kassenwerk.sources.tables import Tables


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("kassenwerk-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "Europe/Zurich")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        # A handful of rows: compiling each stage would take longer than running it.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return date.fromisoformat(text) if text else None


def at(text):
    return datetime.fromisoformat(text) if text else None


def money(text):
    return None if text in (None, "") else Decimal(text)


@pytest.fixture
def make_tables(spark):
    """Tables from lists of dicts; missing fields are NULL, missing tables empty."""

    def build(**rows):
        frames = {
            name: spark.createDataFrame(
                [tuple(r.get(f) for f in TABLES[name].names) for r in given], TABLES[name]
            )
            for name, given in rows.items()
        }
        return Tables.from_frames(spark, **frames)

    return build


@pytest.fixture
def settlement_rows(spark):
    """Settlement rows from CSV-like lines in the order of the report's columns."""

    def build(*lines):
        rows = []
        for line in lines:
            c = line.split(",")
            rows.append(
                (
                    day(c[0]), c[1], c[2], c[3], int(c[4]), c[5], c[6], c[7], c[8],
                    money(c[9]), money(c[10]), money(c[11]), money(c[12]), int(c[13]),
                )
            )
        return spark.createDataFrame(rows, SETTLEMENT_ROW)

    return build


@pytest.fixture
def terminal_rows(spark):
    """Terminal rows from (tid, name, brand, count, unsettled, gross, tip[, currency])."""

    def build(*rows):
        return spark.createDataFrame(
            [
                (r[0], r[1], r[2], r[7] if len(r) > 7 else "CHF", r[3], r[4], money(r[5]), money(r[6]))
                for r in rows
            ],
            TERMINAL_ROW,
        )

    return build


def plan_of(df):
    """Physical plan without what AQE may still change at run time."""
    return df._jdf.queryExecution().executedPlan().toString()

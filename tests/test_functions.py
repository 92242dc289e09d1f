from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kassenwerk.functions import dates, labels, money, text


def one(spark, column, **values):
    """Evaluate ``column`` over one row of string (or typed) values."""
    df = spark.createDataFrame([tuple(values.values()) or (None,)], _schema(values))
    return df.select(column.alias("x")).first()["x"]


def _schema(values):
    kinds = {int: "bigint", Decimal: "decimal(20,8)", datetime: "timestamp_ntz", date: "date"}
    return ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "_ string"


@pytest.mark.parametrize(
    "written, read",
    [
        ("980.15000000", "980.15"), ("0018", "18"), (" 7.25 ", "7.25"), ("-3.07", "-3.07"), ("+.5", "0.5"),
        ("0.00000003", "0.00000003"), (" ", "0"), ("n/a", "0"), ("1e3", "0"), ("5000000000000", "5000000000000"), (None, "0"),
    ],
)
def test_amounts_are_read_exactly_and_unreadable_ones_count_as_zero(spark, written, read):
    assert one(spark, money.read_amount(F.col("a").cast("string")), a=written) == Decimal(read)


@pytest.mark.parametrize(
    "amount, shown",
    [
        ("2085.4", "2’085.40"), ("7", "7.00"), ("0.004", "0.00"), ("9876543.21", "9’876’543.21"),
        ("-620.5", "-620.50"), ("-2085.4", "-2’085.40"), ("0.125", "0.13"), ("-0.125", "-0.13"), ("999.995", "1’000.00"),
    ],
)
def test_swiss_amount(spark, amount, shown):
    assert one(spark, money.swiss_amount(F.col("a")), a=Decimal(amount)) == shown


@pytest.mark.parametrize(
    "number, shown", [(999, "999"), (2085, "2’085"), (-40, "-40"), (-9876543, "-9’876’543")]
)
def test_swiss_integer(spark, number, shown):
    assert one(spark, money.swiss_integer(F.col("n")), n=number) == shown


@pytest.mark.parametrize(
    "amount, shown",
    [("64", "64"), ("2000", "2000"), ("0.7", "0.7"), ("18.05", "18.05"), ("-0.125", "-0.13"), ("48210.9", "48210.9"),
     ("999.995", "1000"), ("0.003", "0")],
)
def test_plain_amount_has_a_point_no_grouping_and_no_trailing_zeros(spark, amount, shown):
    assert one(spark, money.plain_amount(F.col("a")), a=Decimal(amount)) == shown


@pytest.mark.parametrize(
    "end, last",
    [
        ("2026-09-30 18:00:00", date(2026, 9, 30)), ("2026-10-01 00:00:00", date(2026, 9, 30)),
        ("2024-03-01 00:00:00", date(2024, 2, 29)), ("2024-03-01 00:00:01", date(2024, 3, 1)), ("   ", None), (None, None),
    ],
)
def test_report_end_day(spark, end, last):
    assert one(spark, dates.report_end_day(F.col("e").cast("string")), e=end) == last


def test_swiss_date(spark):
    assert one(spark, dates.swiss_date(F.col("d")), d=date(2024, 2, 9)) == "09.02.2024"


@pytest.mark.parametrize(
    "start, end, count",
    [
        (datetime(2026, 1, 1, 23), datetime(2026, 1, 2, 1), 0),
        (datetime(2026, 1, 1, 23), datetime(2026, 1, 2, 23), 1),
        # Summer time starts in between; timestamps without zone do not notice.
        (datetime(2026, 3, 28, 12), datetime(2026, 3, 29, 12), 1),
        (datetime(2026, 3, 1), datetime(2026, 3, 1), 0),
    ],
)
def test_whole_days_count_24_hours_not_midnights(spark, start, end, count):
    assert one(spark, dates.whole_days(F.col("s"), F.col("e")), s=start, e=end) == count


@pytest.mark.parametrize(
    "name, group",
    [
        ("Kiosk 12", "Kiosk"), ("Foyer West  3", "Foyer West"), ("Saal", "Saal"), ("Raum 4 Nord", "Raum 4 Nord"),
        ("7", "7"), ("   ", "–"), (None, "–"),
        ("\tBar 3\t", "Bar"), ("\u00a0Lager\u00a012 \r\n", "Lager"), ("Ab\n7", "Ab"), ("\u3000", "–"), (" 12\t", "12"),
    ],
)
def test_outlet_group(spark, name, group):
    assert one(spark, text.outlet_group(F.col("n").cast("string")), n=name) == group


@pytest.mark.parametrize(
    "brand, group",
    [("Lunch Check", "Lunch-Check"), ("Maestro", "Rest"), ("PostFinance", "Rest"), (None, "Rest")],
)
def test_brand_group(spark, brand, group):
    assert one(spark, text.brand_group(F.col("b").cast("string"), "Rest"), b=brand) == group


@pytest.mark.parametrize(
    "ident, name, label",
    [
        ("41", "Hafen", "41 · Hafen"), (" 41", "  ", "41"), ("41", None, "41"), (" ", "Hafen ", "Hafen"), ("", " ", ""),
    ],
)
def test_space_label(spark, ident, name, label):
    column = text.space_label(F.col("i").cast("string"), F.col("n").cast("string"))
    assert one(spark, column, i=ident, n=name) == label


@pytest.mark.parametrize(
    "space_id, tag, wanted, own",
    [
        ("12", None, "12", True), ("12", None, "1", False), (None, "907 · Süd", "907", True), ("", "907", "907", True),
        (None, "907 · Süd", "90", False), (None, None, "907", False), ("12", "12 · Nord", None, False),
        ("12", "12 · Nord", "", False),
    ],
)
def test_belongs_to_space(spark, space_id, tag, wanted, own):
    columns = [F.col(c).cast("string") for c in ("s", "t", "w")]
    assert one(spark, text.belongs_to_space(*columns), s=space_id, t=tag, w=wanted) is own


@pytest.mark.parametrize(
    "payload, status",
    [
        ('{"status": "success"}', "SUCCESS"), ('{"status": {"status": "FAILED"}}', "FAILED"),
        ('{"status": "Processing"}', "PROCESSING"), ("{}", ""),
    ],
)
def test_status_text(spark, payload, status):
    assert one(spark, text.status_text(F.col("p")), p=payload) == status


def test_label_text_takes_the_first_match_and_survives_an_empty_array(spark):
    df = spark.createDataFrame(
        [
            ([{"descriptor": "a", "shortTextContent": "1"}, {"descriptor": "a", "shortTextContent": "2"}],),
            ([{"descriptor": "b", "shortTextContent": "3"}],),
            ([],),
            (None,),
        ],
        "labels array<map<string,string>>",
    )
    found = [r[0] for r in df.select(labels.label_text(F.col("labels"), "a")).collect()]
    assert found == ["1", None, None, None]

"""Readers and joins keep every cell, amount and sale."""

from decimal import Decimal

from kassenwerk.functions.money import read_amount
from kassenwerk.operators.enrich import with_account
from kassenwerk.plans.terminal_model import terminal_group_report
from kassenwerk.sources.csv_source import csv_cells, read_terminal_csv


def test_rows_keep_their_own_width(spark, tmp_path):
    path = tmp_path / "stacked.csv"
    path.write_bytes(b'Block\r\nu,v,w\r\n7,"x ""y"", z",9\r\n\r\n"line\nbreak",\r\n')
    cells = [r.cells for r in csv_cells(spark, str(path)).collect()]
    assert cells == [["Block"], ["u", "v", "w"], ["7", 'x "y", z', "9"], ["line\nbreak", ""]]


def test_large_amounts_are_read_and_exponents_are_not(spark):
    texts = ["4321098765432", "-0.5", "+12.", ".25", "1e3", "k.A.", "", None, "100000000000000000000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(read_amount(df.t)).collect()]
    zero = Decimal(0)
    assert found == [Decimal(4321098765432), Decimal("-0.5"), Decimal(12), Decimal("0.25"), zero, zero, zero, zero, Decimal(10) ** 20]


def test_spaces_without_account_keep_their_sales(make_tables):
    tables = make_tables(
        transaction=[dict(id=i, spaceid=s) for i, s in ((1, 5), (2, 6), (3, 6))],
        spacereference=[dict(spaceid=6, accountid=31), dict(spaceid=6, accountid=30)],
    )
    rows = with_account(tables, tables.transaction).select("id", "accountid").collect()
    assert sorted((r.id, r.accountid) for r in rows) == [(1, None), (2, 30), (3, 30)]


def test_a_repeated_mapping_row_doubles_nothing(spark, terminal_rows):
    rows = terminal_rows(("T7", "Theke 3", "Visa", 1, 0, "31.00", "2.00"))
    saved = spark.createDataFrame([("T7", "Foyer"), ("T7", "Foyer"), ("T7", " ")], "terminal_identifier string, outlet string")
    totals = terminal_group_report(rows, saved).filter("level = 'grand_total'").collect()
    assert [t.complete_demand for t in totals] == [Decimal("31.00")]


def test_rows_of_another_width_are_reported(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text(
        "terminal_identifier,terminal_name,brand,unsettled_anzahl,brutto_gross,tip_total\n"
        "T1,Theke,Visa,0,8.50,0\nT2,Theke\n"
    )
    read = read_terminal_csv(spark, str(path))
    assert [r.terminal_identifier for r in read.rows.collect()] == ["T1"]
    assert [r.line for r in read.malformed.collect()] == ["T2,Theke"]

"""Totals of the terminal report against the published golden figures."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kassenwerk.plans import terminal_model as model

# Golden totals per outlet and brand group of the 69-row sample
# (outlet, brand group, gross, tip, unmatched, count, input rows).
GOLDEN = [
    ("Bar", "Default", "11325.81", "76.83", 131, 351, 11),
    ("Bistro", "Default", "3694.25", "81.47", 1, 103, 4),
    ("Dachgarten", "Default", "6262.32", "71.30", 165, 192, 7),
    ("Dachgarten", "Lunch-Check", "31.00", "0.00", 1, 2, 1),
    ("Empfang", "Default", "1900.21", "6.33", 27, 61, 3),
    ("Galerie", "Default", "4032.61", "41.50", 34, 63, 4),
    ("Kiosk", "Default", "2675.97", "49.84", 92, 197, 5),
    ("Saal Nord", "Default", "8699.07", "128.28", 84, 227, 9),
    ("Saal Süd", "Default", "2741.10", "60.16", 6, 116, 3),
    ("Terrasse", "Default", "16180.91", "161.25", 270, 508, 16),
    ("Weinkeller", "Default", "5212.91", "116.50", 78, 250, 6),
]
GRAND = (Decimal("62756.16"), Decimal("793.46"), 889, 2070)


def sample_rows():
    """Rows that add up to the golden figures: each total is split over its input rows."""
    rows = []
    for outlet, group, gross, tip, unmatched, count, pieces in GOLDEN:
        gross_cents, tip_cents = int(Decimal(gross) * 100), int(Decimal(tip) * 100)

        def share(total, i, pieces=pieces):
            return total // pieces + (total % pieces if i == pieces - 1 else 0)

        for i in range(pieces):
            terminal = i % 3 + 1
            brand = "Lunch Check" if group == "Lunch-Check" else f"Brand {i}"
            rows.append(
                (
                    f"{outlet}/{terminal}", f"{outlet} {terminal}", brand, share(count, i), share(unmatched, i),
                    str(Decimal(share(gross_cents, i)) / 100), str(Decimal(share(tip_cents, i)) / 100),
                )
            )
    return rows


@pytest.fixture
def sample(terminal_rows):
    return terminal_rows(*sample_rows())


def figures(row):
    return row.complete_demand, row.tip, row.unmatched, row["count"]


def level(df, name):
    return [r for r in df.collect() if r.level == name]


def test_golden_totals(sample):
    assert sample.count() == 69
    report = model.terminal_group_report(sample)
    outlets = level(report, model.OUTLET)
    assert [(r.outlet, r.brand_group) for r in outlets] == sorted(
        [(g[0], g[1]) for g in GOLDEN], key=lambda g: (g[0].replace("ü", "u"), g[1])
    )
    expected = {(g[0], g[1]): (Decimal(g[2]), Decimal(g[3]), g[4], g[5]) for g in GOLDEN}
    assert {(r.outlet, r.brand_group): figures(r) for r in outlets} == expected
    groups = {r.brand_group: figures(r) for r in level(report, model.BRAND_GROUP)}
    assert groups == {
        "Default": (Decimal("62725.16"), Decimal("793.46"), 888, 2068),
        "Lunch-Check": (Decimal(31), 0, 1, 2),
    }
    assert [figures(r) for r in level(report, model.GRAND)] == [GRAND]
    assert len(level(report, model.DETAIL)) == 69


def test_levels_add_up(sample):
    rows = model.terminal_group_report(sample).collect()
    for name in (model.DETAIL, model.OUTLET, model.BRAND_GROUP):
        parts = [figures(r) for r in rows if r.level == name]
        assert tuple(map(sum, zip(*parts))) == GRAND


def test_merging_outlets_by_name_keeps_the_grand_total(spark, sample):
    saved = spark.createDataFrame(
        [("Saal Nord/1", "Saal"), ("Saal Nord/2", "Saal"), ("Saal Nord/3", "Saal"),
         ("Saal Süd/1", "Saal"), ("Saal Süd/2", "Saal"), ("Saal Süd/3", "Saal"), ("gone", "Alt")],
        "terminal_identifier string, outlet string",
    )
    report = model.terminal_group_report(sample, outlets=saved)
    outlets = {r.outlet for r in level(report, model.OUTLET)}
    assert len(outlets) == 9 and "Saal" in outlets and not outlets & {"Saal Nord", "Saal Süd", "Alt"}
    assert [figures(r) for r in level(report, model.GRAND)] == [GRAND]
    merged = {r.tid for r in level(report, model.DETAIL) if r.outlet == "Saal"}
    assert len(merged) == 6


def test_merging_brand_groups(spark, sample):
    every = sample.select("brand").distinct().withColumn("brand_group", F.lit("Alle Marken"))
    report = model.terminal_group_report(sample, brand_groups=every)
    assert [(r.brand_group, figures(r)) for r in level(report, model.BRAND_GROUP)] == [("Alle Marken", GRAND)]


def test_outlets_sort_in_german_order(terminal_rows):
    names = ["Zelt 1", "Österreich 1", "Saal Süd 1", "Saal Nord 1", "apfel 1", "Bar 1"]
    rows = terminal_rows(*[(n, n, "Visa", 1, 0, "1", "0") for n in names])
    found = [r.outlet for r in level(model.terminal_group_report(rows), model.OUTLET)]
    assert found == ["apfel", "Bar", "Österreich", "Saal Nord", "Saal Süd", "Zelt"]


def test_currencies_are_never_added(terminal_rows):
    rows = terminal_rows(("1", "A 1", "Visa", 1, 0, "10", "0", "CHF"), ("1", "A 1", "Visa", 1, 0, "100", "0", "EUR"))
    grand = level(model.terminal_group_report(rows), model.GRAND)
    assert {r.waehrung: r.complete_demand for r in grand} == {"CHF": 10, "EUR": 100}


def test_empty_input_is_an_empty_but_whole_report(terminal_rows):
    report = model.terminal_group_report(terminal_rows(), by_currency=False)
    assert [(r.level, figures(r)) for r in report.collect()] == [(model.GRAND, (0, 0, 0, 0))]
    assert model.terminal_group_report(terminal_rows()).count() == 0


def test_zero_row_does_not_show_next_to_real_rows(sample):
    by_currency = model.terminal_group_report(sample).drop("waehrung").collect()
    as_one = model.terminal_group_report(sample, by_currency=False).collect()
    assert sorted(map(str, by_currency)) == sorted(map(str, as_one))


def test_default_brand_group_is_a_parameter(sample):
    report = model.terminal_group_report(sample, default_brand_group="Kartenzahlung")
    assert {r.brand_group for r in level(report, model.BRAND_GROUP)} == {"Kartenzahlung", "Lunch-Check"}


def test_merged_mappings_prefer_saved_names_over_the_rule(spark, sample):
    saved = spark.createDataFrame(
        [("Bar/1", "Hauptbar"), ("Bar/2", "   "), ("gone", "Alt")], "terminal_identifier string, outlet string"
    )
    outlets = dict(model.merged_outlets(sample, saved).collect())
    assert (outlets["Bar/1"], outlets["Bar/2"], outlets["Bar/3"]) == ("Hauptbar", "Bar", "Bar")
    assert "gone" not in outlets
    brands = spark.createDataFrame([("Brand 1", "Mobile")], "brand string, brand_group string")
    groups = dict(model.merged_brand_groups(sample, brands).collect())
    assert (groups["Brand 1"], groups["Brand 2"], groups["Lunch Check"]) == ("Mobile", "Default", "Lunch-Check")
    assert set(dict(model.merged_outlets(sample).collect()).values()) == {g[0] for g in GOLDEN}


def test_a_terminal_with_several_brands_is_one_row(sample):
    nested = model.terminals_with_brands(sample).collect()
    assert len({(r.outlet, r.tid) for r in nested}) == len(nested) == len({r.terminal_identifier for r in sample.collect()})
    assert tuple(sum(figures(r)[i] for r in nested) for i in range(4)) == GRAND
    for r in nested:
        assert figures(r) == tuple(sum(figures(b)[i] for b in r.brands) for i in range(4))
    garden = next(r for r in nested if r.tid == "Dachgarten/1")
    assert {b.brand_group for b in garden.brands} == {"Default", "Lunch-Check"} and len(garden.brands) > 1


def test_nested_terminals_in_german_order_with_renamed_ones(terminal_rows):
    rows = terminal_rows(
        ("T1", "Öse 2", "Zoll", 1, 0, "5", "1"), ("T1", "Öse 2", "Äpfel", 2, 1, "7", "0"), ("T1", "Öse 2", "Birne", 1, 0, "1", "0"),
        ("T1", "Öse 1", "Zoll", 1, 0, "2", "0"), ("T2", "Pult 1", "Zoll", 1, 0, "3", "0"), ("T3", "Oase", "Zoll", 1, 0, "4", "0", "EUR"),
    )
    nested = model.terminals_with_brands(rows).collect()
    assert [(r.waehrung, r.outlet, r.tid, r.name) for r in nested] == [
        ("CHF", "Öse", "T1", "Öse 1"), ("CHF", "Pult", "T2", "Pult 1"), ("EUR", "Oase", "T3", "Oase"),
    ]
    assert [(b.brand, b.complete_demand, b["count"]) for b in nested[0].brands] == [("Äpfel", 7, 2), ("Birne", 1, 1), ("Zoll", 7, 2)]
    merged = model.terminals_with_brands(rows, by_currency=False).collect()
    assert [r.outlet for r in merged] == ["Oase", "Öse", "Pult"] and "waehrung" not in merged[0].asDict()
    assert model.terminals_with_brands(rows.limit(0)).count() == 0

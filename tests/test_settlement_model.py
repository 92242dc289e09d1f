"""Settlement report on a handful of rows."""

from decimal import Decimal

import pytest

from kassenwerk.plans import settlement_model as model

END = "2026-02-01 00:00:00"


def line(date, ident, gross, fee="0", state="SETTLED", brand="Visa", currency="CHF"):
    net = Decimal(gross) - Decimal(fee)
    return f"{date},{state},{ident},,640,{currency},{brand},Ecommerce,,{gross},{gross},{fee},{net},1"


def open_line(ident, gross, brand="Visa"):
    return f",NO_RECORD,{ident},,640,CHF,{brand},Ecommerce,,{gross},,,,0"


@pytest.fixture
def report(settlement_rows):
    def build(*lines, end=END, detail=False):
        return model.settlement_report(settlement_rows(*lines), end, with_detail=detail)

    return build


def days(r):
    return [(d.nr, str(d.datum) if d.datum else "", d.status, d.anzahl_tx) for d in r.overview.collect()]


def test_rows_are_grouped_by_settlement_date(report):
    r = report(
        line("2026-01-13", 1, "100", "2", brand="TWINT"), line("2026-01-13", 2, "50", "1"),
        line("2026-01-19", 3, "20", "0.5"),
    )
    assert days(r) == [(1, "2026-01-13", "Settled", 2), (2, "2026-01-19", "Settled", 1)]
    first = r.overview.first()
    assert (first.brutto, first.fees, first.netto) == (150, 3, 147)


def test_gross_minus_fees_is_net_everywhere(report):
    r = report(line("2026-01-13", 1, "111.11", "2.13"), line("2026-01-15", 2, "7.77", "0.19"))
    for row in [*r.overview.collect(), r.totals.first(), r.kpis.first(), r.connector_total.first()]:
        assert row.brutto - row.fees == row.netto


def test_sums_are_exact(report):
    r = report(*[line("2026-01-13", 1000 + i, "0.30") for i in range(250)])
    assert r.totals.first().netto == Decimal("75.00")


def test_value_date_after_the_period_is_pending(report):
    r = report(line("2026-01-30", 1, "10", "0.1"), line("2026-02-10", 2, "20", "0.2"))
    assert [d[2] for d in days(r)] == ["Settled", "Ausstehend"]
    p = r.pending.first()
    assert (p.anzahl_settlements, p.anzahl_tx, p.brutto, p.netto) == (1, 1, 20, Decimal("19.8"))


@pytest.mark.parametrize(
    "end, states",
    [
        ("2026-03-31 12:00:00", ["Settled", "Ausstehend"]), ("2026-04-01 00:00:00", ["Settled", "Ausstehend"]),
        ("2026-04-01 00:00:01", ["Settled", "Settled"]), ("", ["Settled", "Settled"]), (None, ["Settled", "Settled"]),
    ],
)
def test_last_day_of_the_period(report, end, states):
    r = report(line("2026-03-31", 1, "10"), line("2026-04-01", 2, "20"), end=end)
    assert [d[2] for d in days(r)] == states


def test_rows_without_record_form_the_open_row_at_the_end(report):
    r = report(
        line("2026-01-13", 1, "10", "0.1"), open_line(2, "73.25"), open_line(3, "26.75", "TWINT"),
    )
    last = r.overview.collect()[-1]
    assert (last.status, last.datum, last.anzahl_tx) == ("Offen", None, 2)
    assert (last.brutto, last.netto) == (100, 0)
    k = r.kpis.first()
    assert (k.anzahl_settlements, k.anzahl_tx, k.netto) == (1, 1, Decimal("9.9"))
    assert (k.offen_anzahl_tx, k.offen_brutto) == (2, 100)
    assert r.totals.first().anzahl_tx == 3


def test_record_without_value_date_is_open_with_its_bank_amount(report):
    r = report(",UPCOMING,1,,1,CHF,Visa,Ecommerce,,50,40,1,39,1", line("2026-01-13", 2, "10"))
    last = r.overview.collect()[-1]
    assert (last.status, last.brutto, last.netto) == ("Offen", 40, 39)
    assert r.connector_total.first().brutto == r.kpis.first().brutto == 10


def test_connectors_by_volume(report):
    r = report(
        line("2026-01-13", 1, "10"), line("2026-01-13", 2, "90", brand="TWINT"), line("2026-01-15", 3, "5"),
    )
    assert [(c.connector, c.anzahl_tx, c.brutto) for c in r.connectors.collect()] == [("TWINT", 1, 90), ("Visa", 2, 15)]
    assert (r.connector_total.first().anzahl_tx, r.connector_total.first().brutto) == (3, 105)


def test_connectors_leave_out_open_rows_and_equal_the_key_figures(report):
    r = report(line("2026-01-13", 1, "10", "0.1"), open_line(2, "73.25"))
    assert [(c.connector, c.anzahl_tx) for c in r.connectors.collect()] == [("Visa", 1)]
    total, k = r.connector_total.first(), r.kpis.first()
    assert (total.brutto, total.fees, total.netto) == (k.brutto, k.fees, k.netto)


def test_equal_volume_sorts_by_name_in_german_order(report):
    names = ["Visa", "Mastercard", "TWINT", "Österreich Pay", "amex"]
    r = report(*[line("2026-01-13", i, "10", brand=b) for i, b in enumerate(names)])
    assert [c.connector for c in r.connectors.collect()] == ["amex", "Mastercard", "Österreich Pay", "TWINT", "Visa"]


def test_detail_is_numbered_by_transaction_id(report):
    r = report(
        line("2026-01-13", 300, "3"), line("2026-01-13", 1000, "1", brand="TWINT"),
        line("2026-01-13", 99, "2"), line("2026-01-19", 1, "2"), open_line(7, "5"), open_line(6, "5"),
        detail=True,
    )
    found = sorted((d.settlement_nr, d.nr, d.transaction_id, d.connector) for d in r.detail.collect())
    assert found == [
        (1, 1, "99", "Visa"), (1, 2, "300", "Visa"), (1, 3, "1000", "TWINT"), (2, 1, "1", "Visa"),
        (3, 1, "6", "Visa"), (3, 2, "7", "Visa"),
    ]


def test_average_counts_dated_settlements_only(report):
    r = report(line("2026-01-13", 1, "10"), line("2026-01-15", 2, "30"), open_line(3, "99"))
    assert r.kpis.first().avg_netto == 20
    thirds = report(line("2026-01-13", 1, "10"), line("2026-01-15", 2, "5"), line("2026-01-19", 3, "5"))
    assert thirds.kpis.first().avg_netto == Decimal("6.66666667")


def test_no_rows_give_an_empty_but_whole_report(report):
    r = report(detail=True)
    assert r.overview.count() == r.connectors.count() == r.detail.count() == 0
    k = r.kpis.first()
    assert (k.anzahl_settlements, k.anzahl_tx, k.avg_netto, k.brutto, k.waehrungen) == (0, 0, 0, 0, [])
    assert r.pending.first().anzahl_settlements == 0
    assert r.totals.first().anzahl_tx == 0


def test_all_three_states(report):
    r = report(line("2026-01-13", 1, "10"), line("2026-02-10", 2, "20"), open_line(3, "73.25"))
    assert [d[2] for d in days(r)] == ["Settled", "Ausstehend", "Offen"]
    assert r.kpis.first().anzahl_settlements == 2
    totals = r.totals.first()
    assert totals.brutto - totals.fees != totals.netto


def test_second_currency_is_refused_and_both_are_named(report):
    r = report(line("2026-01-13", 1, "10"), line("2026-01-13", 2, "60", currency="EUR"), open_line(3, "1"), detail=True)
    refused = r.refused.first()
    assert refused.waehrungen == ["CHF", "EUR"] and refused.meldung.endswith("(Währungen): CHF, EUR")
    for part in (r.overview, r.connectors, r.connector_total, r.pending, r.totals, r.detail):
        assert part.count() == 0
    k = r.kpis.first()
    assert (k.waehrungen, k.anzahl_tx, k.brutto, k.netto, k.avg_netto) == (["CHF", "EUR"], 2, None, None, None)


def test_other_scopes_are_reported_beside_a_refused_one(settlement_rows):
    rows = settlement_rows(
        line("2026-01-13", 1, "10"), line("2026-01-15", 2, "20", currency="EUR"),
        line("2026-01-15", 3, "45").replace(",640,", ",7,"),
    )
    r = model.settlement_report(rows, END, scope=["space_id"])
    assert [(d.space_id, d.brutto) for d in r.overview.collect()] == [(7, 45)]
    assert [(d.space_id, d.waehrungen) for d in r.refused.collect()] == [(640, ["CHF", "EUR"])]
    assert {(k.space_id, k.netto) for k in r.kpis.collect()} == {(7, 45), (640, None)}
    assert [d.transaction_id for d in r.detail.collect()] == ["3"]


def test_one_currency_is_listed(report):
    r = report(line("2026-01-13", 1, "10"), line("2026-01-15", 2, "20"))
    assert r.kpis.first().waehrungen == ["CHF"]


def test_scopes_are_reported_side_by_side(settlement_rows):
    rows = settlement_rows(
        line("2026-01-13", 1, "10"), line("2026-01-15", 2, "20"),
        line("2026-01-15", 3, "100", currency="EUR").replace("640", "7"),
    )
    r = model.settlement_report(rows, END, scope=["space_id"])
    found = [(d.space_id, d.nr, d.anzahl_tx, d.brutto, d.waehrungen) for d in r.overview.collect()]
    assert found == [(7, 1, 1, 100, ["EUR"]), (640, 1, 1, 10, ["CHF"]), (640, 2, 1, 20, ["CHF"])]
    numbers = sorted((d.space_id, d.settlement_nr, d.nr) for d in r.detail.collect())
    assert numbers == [(7, 1, 1), (640, 1, 1), (640, 2, 1)]

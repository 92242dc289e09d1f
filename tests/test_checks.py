"""Verification queries on the tables of the report tests."""

from decimal import Decimal

from kassenwerk.plans import checks
from tests.test_reports import START, END, shop  # noqa: F401 - fixture

SPAN = ([1, 2], START, END)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bank_states(shop):
    found = {r.zustand: r for r in checks.bank_states(shop, *SPAN).collect()}
    upcoming = found["UPCOMING"]
    assert (upcoming.anzahl, upcoming.mit_valuedate, upcoming.ohne_valuedate) == (2, 1, 1)
    assert found["SETTLED"].frueheste_valuta.hour == 6


def test_fee_sign(shop):
    settled = {r.zustand: r for r in checks.fee_sign_check(shop, *SPAN).collect()}["SETTLED"]
    assert (settled.summe_postingamount, settled.summe_valueamount, settled.summe_differenz) == (90, 88, 2)
    assert (settled.min_differenz, settled.max_differenz, settled.anzahl_negativ, settled.anzahl_null) == (1, 1, 0, 0)


def test_counts(shop):
    assert rows(checks.records_per_transaction(shop, *SPAN)) == [(1, 2), (2, 1)]
    assert rows(checks.settlement_coverage(shop, *SPAN)) == [(7, 3, 4)]
    assert rows(checks.settlement_record_count(shop, *SPAN)) == [(4,)]
    assert rows(checks.settlement_record_count(shop, [], START, END)) == [(0,)]
    assert rows(checks.fee_record_matrix(shop, *SPAN)) == [
        ("mit Gebuehr", "mit Record", 1), ("ohne Gebuehr", "mit Record", 2), ("ohne Gebuehr", "ohne Record", 4),
    ]


def test_payout_delay(shop):
    # Value dates 05-12 00:00 and 05-11 06:00 against 05-11 07:00, 05-12 00:00 and 05-13 10:00.
    assert rows(checks.payout_delay_all(shop, *SPAN)) == [(0, 3), (1, 1), (2, 1)]
    assert rows(checks.payout_delay_prefiltered(shop, *SPAN)) == [(0, 3), (1, 1), (2, 1)]
    assert rows(checks.payout_delay_all(shop, *SPAN, window_days=1)) == [(0, 3)]
    assert rows(checks.payout_delay_account(shop, *SPAN)) == [(0, 2), (1, 1), (2, 1)]


def test_withdrawals(shop):
    assert checks.withdrawal_count(shop, START, END).first().anzahl_auszahlungen == 3
    own = checks.withdrawal_count_account(shop, [1], START, END).first()
    assert (own.anzahl_auszahlungen, own.anzahl_accounts) == (2, 1)


def test_line_items(shop):
    assert rows(checks.lineitem_types(shop, [1])) == [("TIP", 2, Decimal(10)), ("PRODUCT", 1, Decimal(90))]
    assert rows(checks.tip_inclusion_check(shop, *SPAN)) == [(1, 100, 10, 100, 0)]


def test_samples_are_limited(shop):
    sample = checks.bank_reference_sample(shop, *SPAN, rows=2)
    assert [r.banktransaction_id for r in sample.collect()] == ["a", "b"]

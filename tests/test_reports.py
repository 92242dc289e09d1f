"""Report queries on small tables with several records, attempts and line items per sale."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kassenwerk.operators import enrich, timeline
from kassenwerk.plans import reports
from kassenwerk.schema import TABLES
from tests.conftest import at, money, plan_of

START, END = "2026-05-01 00:00:00", "2026-06-01 00:00:00"
WINDOW = (START, END)


def sale(ident, when="2026-05-10 12:00:00", amount="100", fee=None, space=1, **more):
    return {
        "id": ident, "spaceid": space, "createdon": at(when), "completedon": at(when),
        "state": "FULFILL", "currency": "CHF", "completedamount": money(amount),
        "totalappliedfees": money(fee), "paymentconnectorconfiguration_id": 1, "terminal_id": 11,
        "merchantreference": f"ref-{ident}", **more,
    }


def bank(ident, state, value_date, posting="10", value="9"):
    return {
        "id": ident, "state": state, "valuedate": at(value_date),
        "postingamount": money(posting), "valueamount": money(value),
    }


def label(card, code):
    return [
        {"descriptor": "1456765125779", "shortTextContent": card},
        {"descriptor": "1579287795628", "shortTextContent": code},
    ]


@pytest.fixture
def shop(make_tables):
    return make_tables(
        transaction=[
            sale(1, amount="100", fee="2"),
            sale(2, amount="50"),
            sale(3, amount="30", fee="0"),
            sale(4, amount="20", terminal_id=None, paymentconnectorconfiguration_id=9),
            sale(5, state="PENDING"),
            sale(6, when=START),
            sale(7, when=END),
            sale(8, when="2026-05-31 23:59:59", space=2, terminal_id=11),
            sale(9, when="2026-05-12 00:00:00", currency="EUR"),
        ],
        paymentconnectorconfiguration=[
            {"id": 1, "spaceid": 1, "connector": 100, "name": "Config"},
            {"id": 1, "spaceid": 2, "connector": 200, "name": "Configured only"},
        ],
        paymentconnector=[
            {"id": 100, "name": {"en-US": "Visa"}},
            {"id": 200, "name": {"de-DE": "Nur deutsch"}},
        ],
        paymentterminal=[
            {"id": 11, "spaceid": 1, "identifier": "T-11", "name": "Bar 1"},
            {"id": 11, "spaceid": 2, "identifier": "T-11b", "name": "Bar 2"},
        ],
        charge=[{"id": 10, "transaction_id": 1}, {"id": 20, "transaction_id": 2}],
        chargeattempt=[
            {"id": 1, "charge_id": 10, "spaceid": 1, "labels": label("XXXX-0001", "A1")},
            {"id": 2, "charge_id": 10, "spaceid": 1, "labels": label("XXXX-7873", "A2")},
            {"id": 3, "charge_id": 20, "spaceid": 1, "labels": label("XXXX-7873", "A3")},
            {"id": 4, "charge_id": 20, "spaceid": 1, "labels": []},
        ],
        payfacsettlementrecord=[
            {"transaction_id": 1, "banktransaction_id": "a"},
            {"transaction_id": 1, "banktransaction_id": "b"},
            {"transaction_id": 3, "banktransaction_id": "c"},
            {"transaction_id": 9, "banktransaction_id": "d"},
        ],
        banktransaction=[
            bank("a", "SETTLED", "2026-05-12 00:00:00", "60", "59"),
            bank("b", "UPCOMING", None, "40", "39.5"),
            bank("c", "SETTLED", "2026-05-11 06:00:00", "30", "29"),
            bank("d", "UPCOMING", "2026-05-20 00:00:00"),
        ],
        transaction_lineitem=[
            {"transaction_id": 1, "lineitems_id": "x", "spaceid": 1},
            {"transaction_id": 1, "lineitems_id": "y", "spaceid": 1},
            {"transaction_id": 1, "lineitems_id": "z", "spaceid": 1},
        ],
        lineitem=[
            {"id": "x", "spaceid": 1, "type": "PRODUCT", "amountincludingtax": money("90")},
            {"id": "y", "spaceid": 1, "type": "TIP", "amountincludingtax": money("7")},
            {"id": "z", "spaceid": 1, "type": "TIP", "amountincludingtax": money("3")},
            {"id": "x", "spaceid": 2, "type": "TIP", "amountincludingtax": money("999")},
        ],
        spacereference=[{"spaceid": 1, "accountid": 500}, {"spaceid": 2, "accountid": 600}],
        currentaccountwithdrawal=[
            {"internalreference": "W-late", "createdon": at("2026-05-13 10:00:00"), "accountid": 500},
            {"internalreference": "W-same", "createdon": at("2026-05-12 00:00:00"), "accountid": 500},
            {"internalreference": "W-other", "createdon": at("2026-05-11 07:00:00"), "accountid": 600},
        ],
    )


def test_brand_report(shop):
    rows = {
        (r.space_id, r.brand, r.waehrung): r for r in reports.brand_report(shop, [1, 2], *WINDOW).collect()
    }
    assert set(rows) == {
        (1, "Visa", "CHF"), (1, "Visa", "EUR"), (1, "UNKNOWN", "CHF"), (2, "Configured only", "CHF"),
    }
    visa = rows[1, "Visa", "CHF"]
    # Sales 1, 2, 3 and 6; two bank rows and two tips must not multiply sale 1.
    assert (visa.anzahl_transaktionen, visa.brutto_gross) == (4, Decimal(280))
    assert (visa.transaction_fee_total, visa.netto, visa.tip_total) == (2, 278, 10)
    # No fee and no record: 2 and 6. Sale 3 has fee zero but a record.
    assert visa.unsettled_anzahl == 2
    unknown = rows[1, "UNKNOWN", "CHF"]
    assert (unknown.transaction_fee_total, unknown.netto, unknown.tip_total) == (None, 20, 0)


def test_tip_join_changes_neither_count_nor_gross(shop, make_tables):
    def figures(tables):
        return reports.brand_report(tables, [1, 2], *WINDOW).agg(
            F.sum("anzahl_transaktionen"), F.sum("brutto_gross")
        ).first()

    without = {n: shop[n] for n in ("transaction", "paymentterminal", "payfacsettlementrecord")}
    bare = type(shop).from_frames(shop.transaction.sparkSession, **without)
    assert figures(shop) == figures(bare)


def test_terminal_report_needs_terminals(shop):
    rows = reports.terminal_report(shop, [1, 2], *WINDOW, ["T-11"]).collect()
    assert {(r.space_id, r.terminal_identifier, r.terminal_name) for r in rows} == {(1, "T-11", "Bar 1")}
    assert sum(r.anzahl_transaktionen for r in rows) == 5
    assert reports.terminal_report(shop, [1, 2], *WINDOW, []).count() == 0
    both = reports.terminal_report(shop, [1, 2], *WINDOW, ["T-11", "T-11b"]).collect()
    assert {r.space_id for r in both} == {1, 2}


def test_no_space_selected_reports_nothing(shop):
    assert reports.brand_report(shop, [], *WINDOW).count() == 0
    assert reports.terminal_report(shop, [], *WINDOW, ["T-11"]).count() == 0
    every = reports.EXPORT_COLUMNS.keys()
    assert reports.transaction_export(shop, [], *WINDOW, columns=every).count() == 0
    assert reports.card_search(shop, [], *WINDOW, "7873").count() == 0


def test_window_is_half_open(shop):
    rows = reports.transaction_export(shop, [1, 2], *WINDOW, columns=["merchantref"]).collect()
    found = {r.merchant_reference for r in rows}
    assert "ref-6" in found and "ref-8" in found
    assert "ref-7" not in found and "ref-5" not in found


def test_full_export(shop):
    df = reports.transaction_export(shop, [1], *WINDOW, columns=reports.EXPORT_COLUMNS.keys())
    assert df.columns == [c.alias for c in reports.EXPORT_COLUMNS.values()]
    rows = {r.merchant_reference: r for r in df.collect()}
    first = rows["ref-1"]
    assert first.settlement_state == "PARTIAL"
    assert first.auszahlungsdatum == at("2026-05-12 00:00:00")
    # The withdrawal at the very value date counts; the other account's never does.
    assert first.settlement_reference == "W-same"
    assert rows["ref-3"].settlement_reference == "W-same"
    assert (first.masked_card, first.auth_code) == ("XXXX-7873", "A2")
    assert (first.tip_amount, first.gross_excl_tip) == (10, 90)
    assert (first.processing_fees, first.net_amount) == (2, 98)
    second = rows["ref-2"]
    # The latest attempt has no labels; an earlier attempt does not stand in for it.
    assert (second.masked_card, second.settlement_state, second.processing_fees) == (None, None, 0)
    assert (second.tip_amount, second.gross_excl_tip) == (0, 50)
    assert rows["ref-4"].terminal_identifier is None
    assert rows["ref-9"].settlement_reference is None


def test_export_defaults_leave_out_payout_reference_and_tips():
    assert set(reports.EXPORT_COLUMNS) - set(reports.DEFAULT_COLUMNS) == {"payoutref", "tip", "grossnotip"}


def test_unknown_export_column_is_refused(shop):
    with pytest.raises(ValueError, match="colour"):
        reports.transaction_export(shop, [1], *WINDOW, columns=["gross", "colour"])


def test_payout_window_is_ten_days(make_tables):
    def shop_with(moment):
        return make_tables(
            transaction=[sale(1)],
            payfacsettlementrecord=[{"transaction_id": 1, "banktransaction_id": "a"}],
            banktransaction=[bank("a", "SETTLED", "2026-05-12 00:00:00")],
            spacereference=[{"spaceid": 1, "accountid": 5}],
            currentaccountwithdrawal=[
                {"internalreference": "W", "createdon": at(moment), "accountid": 5}
            ],
        )

    def reference(moment):
        df = reports.transaction_export(shop_with(moment), [1], *WINDOW, columns=["payoutref"])
        return df.first().settlement_reference

    assert reference("2026-05-21 23:59:59") == "W"
    assert reference("2026-05-22 00:00:00") is None
    assert reference("2026-05-11 23:59:59") is None


@pytest.mark.parametrize(
    "typed, found",
    [("7873", {1}), ("73", {1}), ("78'; DROP--", set()), ("7 8-73", {1}), ("", set()), ("abc", set())],
)
def test_card_search_matches_the_digits_as_suffix(shop, typed, found):
    rows = reports.card_search(shop, [1, 2], *WINDOW, typed)
    assert {r.transaction_id for r in rows.collect()} == found
    assert rows.columns == [
        "space_id", "completedon", "terminal_identifier", "terminal_name", "gross_amount", "waehrung",
        "brand", "masked_card", "auth_code", "transaction_id", "state",
    ]


def test_card_search_with_terminals(shop):
    assert reports.card_search(shop, [1], *WINDOW, "7873", ["T-11", "T-x"]).count() == 1
    assert reports.card_search(shop, [1], *WINDOW, "7873", ["T-x"]).count() == 0


def test_settlement_transactions_cover_all_spaces_one_row_each(shop):
    rows = {r.transaction_id: r for r in reports.settlement_transactions(shop, *WINDOW).collect()}
    assert set(rows) == {1, 2, 3, 4, 6, 8, 9}
    first = rows[1]
    assert (first.settlement_state, str(first.settlement_datum)) == ("PARTIAL", "2026-05-12")
    assert (first.settlement_gross, first.processing_fees, first.netamount) == (100, Decimal("1.5"), Decimal("98.5"))
    assert first.settlement_records == 2
    missing = rows[2]
    assert (missing.settlement_state, missing.settlement_datum) == ("NO_RECORD", None)
    assert (missing.settlement_gross, missing.settlement_records) == (None, 0)
    assert rows[9].settlement_state == "UPCOMING"
    assert (rows[4].sales_channel, rows[1].sales_channel) == ("Ecommerce", "Physical Terminal")
    assert (rows[4].connector, rows[8].connector) == ("UNKNOWN", "Configured only")


def test_settlement_transactions_of_one_account(shop):
    rows = reports.settlement_transactions(shop, *WINDOW, account=600, with_account=True).collect()
    assert [(r.account_id, r.transaction_id) for r in rows] == [(600, 8)]


def test_historic_sample_ignores_account_and_window(shop):
    rows = {r.merchant_reference: r for r in reports.settlement_reference_sample(shop, [1], *WINDOW).collect()}
    assert rows["ref-3"].settlement_reference == "W-other"
    assert rows["ref-1"].settlement_reference == "W-same"
    assert rows["ref-9"].auszahlungsdatum is None
    assert len(rows["ref-1"]) == 18


def test_settlement_state_counts_instead_of_looking_at_the_latest_date(spark):
    rows = [
        (1, "SETTLED"), (1, "UPCOMING"), (2, "SETTLED"), (2, "SETTLED"), (3, "UPCOMING"), (4, "FAILED"), (5, None),
    ]
    df = spark.createDataFrame(rows, "id int, state string").groupBy("id").agg(
        enrich.settlement_state(F.col("state")).alias("s")
    )
    assert dict(df.collect()) == {1: "PARTIAL", 2: "SETTLED", 3: "UPCOMING", 4: "UPCOMING", 5: "UPCOMING"}


# --- Plans -------------------------------------------------------------------


def on_disk(spark, shop, folder):
    for name in TABLES:
        shop[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    return type(shop).from_parquet(spark, str(folder))


def scanned(df, tables):
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString(" ")
    files = plan + " ".join(df.inputFiles())
    return {name for name in TABLES if f"/{name}/" in files}


@pytest.mark.parametrize(
    "columns, needed",
    [
        (["spaceid", "gross"], set()),
        (["tip"], {"transaction_lineitem", "lineitem"}),
        (["maskedcard"], {"charge", "chargeattempt"}),
        (["settlestate"], {"payfacsettlementrecord", "banktransaction"}),
        (["connectorname"], {"paymentconnectorconfiguration", "paymentconnector"}),
        (["terminal"], {"paymentterminal"}),
        (
            ["payoutref"],
            {"payfacsettlementrecord", "banktransaction", "currentaccountwithdrawal", "spacereference"},
        ),
    ],
)
def test_export_reads_only_the_tables_its_columns_need(spark, shop, tmp_path, monkeypatch, columns, needed):
    tables, read = on_disk(spark, shop, tmp_path), set()
    # The line of payouts is written while the export is built; what it reads counts as well.
    written = timeline.written
    monkeypatch.setattr(timeline, "written", lambda df, label: read.update(scanned(df, tables)) or written(df, label))
    df = reports.transaction_export(tables, [1], *WINDOW, columns=columns)
    assert scanned(df, tables) | read == {"transaction"} | needed


def test_filters_and_columns_reach_the_scan(spark, shop, tmp_path):
    tables = on_disk(spark, shop, tmp_path)
    plan = plan_of(reports.transaction_export(tables, [1], *WINDOW, columns=["gross"]))
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("GreaterThanOrEqual(completedon", "LessThan(completedon", "EqualTo(spaceid,1)", "In(state"):
        assert part in pushed
    schema = plan[plan.index("ReadSchema"):]
    assert "completedamount" in schema and "merchantreference" not in schema


def test_a_small_report_is_pushed_down_to_the_settlement_scan(spark, shop, tmp_path):
    """With few transactions the semi-join runs before records are aggregated or shuffled."""
    tables = on_disk(spark, shop, tmp_path)
    tx = tables.transaction.filter("spaceid = 1")
    plan = enrich.has_record(tables, tx)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


# --- What is shuffled --------------------------------------------------------


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved_by(plan):
    """First key of every shuffle by keys."""
    return sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan))


def test_the_export_moves_the_texts_of_bank_ids_once(spark, shop, tmp_path, no_broadcast, monkeypatch):
    """Once with the records and once with the bank rows, over all jobs of the export."""
    tables, plans, write = on_disk(spark, shop, tmp_path), [], timeline.written
    for module in (timeline, reports):
        monkeypatch.setattr(module, "written", lambda df, label: plans.append(plan_of(df)) or write(df, label), raising=False)
    df = reports.transaction_export(tables, [1, 2], *WINDOW, columns=reports.EXPORT_COLUMNS.keys())
    plans.append(plan_of(df))
    assert [key for plan in plans for key in moved_by(plan)].count("banktransaction_id") == 2
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = reports.transaction_export(tables, [1, 2], *WINDOW, columns=reports.EXPORT_COLUMNS.keys())
    assert sorted(map(repr, df.collect())) == sorted(map(repr, plain.collect())) != []


def test_value_dates_are_dealt_out_once(spark, shop, tmp_path, no_broadcast):
    tables = on_disk(spark, shop, tmp_path)
    dates = enrich.value_dates(tables, tables.transaction.filter("spaceid = 1"))
    assert moved_by(plan_of(dates)) == ["banktransaction_id"] * 2 + ["transaction_id"] * 2
    assert sorted((r.transaction_id, r.state) for r in dates.collect()) == [
        (1, "SETTLED"), (1, "UPCOMING"), (3, "SETTLED"), (9, "UPCOMING"),
    ]


def test_tips_move_the_texts_of_line_items_once(spark, shop, tmp_path, no_broadcast):
    """By transaction only sums are moved, and the report's ids."""
    tables = on_disk(spark, shop, tmp_path)
    tips = enrich.tips(tables, tables.transaction.filter("spaceid = 1"), [1])
    assert moved_by(plan_of(tips)) == ["lineitems_id"] * 2 + ["transaction_id"] * 2
    assert [tuple(r) for r in tips.collect()] == [(1, 10)]


def test_cards_move_two_texts_instead_of_all_labels(spark, shop, tmp_path, no_broadcast):
    tables = on_disk(spark, shop, tmp_path)
    plan = plan_of(enrich.cards(tables, tables.transaction.filter("spaceid = 1"))).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    taken = [i for i, line in enumerate(plan) if "Project" in line and "filter(labels" in line]
    assert taken
    for i in taken:
        assert any("Exchange hashpartitioning" in line and depth(line) < depth(plan[i]) for line in plan[:i])
    found = enrich.cards(tables, tables.transaction.filter("spaceid = 1")).collect()
    assert sorted(map(tuple, found)) == [(1, "XXXX-7873", "A2"), (2, None, None)]

"""Verification queries on settlement records, fees, payouts and tips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassenwerk.functions.money import total
from kassenwerk.operators import enrich
from kassenwerk.operators.filters import Moment, one_of, report_transactions, within
from kassenwerk.operators.timeline import pairs_by_whole_days
from kassenwerk.schema import TOTAL
from kassenwerk.sources.tables import Tables


def bank_states(tables: Tables, spaces: Sequence[int], start: Moment, end: Moment) -> DataFrame:
    """Bank transaction states, how many carry a value date, earliest and latest one."""
    rows = enrich.bank_rows(tables, report_transactions(tables, spaces, start, end))
    return (
        rows.groupBy(F.col("state").alias("zustand"))
        .agg(
            F.count("*").alias("anzahl"),
            F.count("valuedate").alias("mit_valuedate"),
            (F.count("*") - F.count("valuedate")).alias("ohne_valuedate"),
            F.min("valuedate").alias("frueheste_valuta"),
            F.max("valuedate").alias("spaeteste_valuta"),
        )
        .orderBy(F.desc("anzahl"))
    )


def fee_sign_check(tables: Tables, spaces: Sequence[int], start: Moment, end: Moment) -> DataFrame:
    """Sign of posting minus value per bank transaction state."""
    rows = enrich.bank_rows(tables, report_transactions(tables, spaces, start, end))
    fee = F.col("postingamount") - F.col("valueamount")
    return (
        rows.groupBy(F.col("state").alias("zustand"))
        .agg(
            F.count("*").alias("anzahl"),
            total(F.col("postingamount")).alias("summe_postingamount"),
            total(F.col("valueamount")).alias("summe_valueamount"),
            total(fee).alias("summe_differenz"),
            F.min(fee).alias("min_differenz"),
            F.max(fee).alias("max_differenz"),
            F.count_if(fee < 0).alias("anzahl_negativ"),
            F.count_if(fee == 0).alias("anzahl_null"),
        )
        .orderBy(F.desc("anzahl"))
    )


def _payout_delay(starts: DataFrame, withdrawals: DataFrame, window_days: int) -> DataFrame:
    return pairs_by_whole_days(
        starts.filter("state = 'SETTLED'"),
        withdrawals,
        scope=[],
        at="valuedate",
        event_at="createdon",
        window_days=window_days,
        day="tage_bis_auszahlung",
        count="anzahl",
    ).orderBy("tage_bis_auszahlung")


def payout_delay_all(
    tables: Tables,
    spaces: Sequence[int],
    start: Moment,
    end: Moment,
    window_days: int = 45,
) -> DataFrame:
    """Days from value date to every later withdrawal in the window, over all accounts."""
    bounded = within(tables.currentaccountwithdrawal, "createdon", start, end, window_days)
    tx = report_transactions(tables, spaces, start, end)
    return _payout_delay(enrich.bank_rows(tables, tx), bounded, window_days)


def payout_delay_prefiltered(
    tables: Tables,
    spaces: Sequence[int],
    start: Moment,
    end: Moment,
    window_days: int = 15,
) -> DataFrame:
    """As above with the withdrawals cut to the report period itself."""
    tx = report_transactions(tables, spaces, start, end)
    bounded = within(tables.currentaccountwithdrawal, "createdon", start, end)
    return _payout_delay(enrich.bank_rows(tables, tx), bounded, window_days)


def payout_delay_account(
    tables: Tables,
    spaces: Sequence[int],
    start: Moment,
    end: Moment,
    window_days: int = 30,
) -> DataFrame:
    """As above, each transaction against the withdrawals of its own account only."""
    tx = enrich.with_account(tables, report_transactions(tables, spaces, start, end)).select(
        F.col("id").alias("transaction_id"), "accountid"
    )
    bank = tables.banktransaction.filter("state = 'SETTLED'").select(
        F.col("id").alias("banktransaction_id"), "valuedate"
    )
    starts = tables.payfacsettlementrecord.join(tx, "transaction_id").join(
        bank, "banktransaction_id"
    )
    return pairs_by_whole_days(
        starts,
        enrich.account_withdrawals(tables, spaces, start, end),
        scope=["accountid"],
        at="valuedate",
        event_at="createdon",
        window_days=window_days,
        day="tage_bis_auszahlung",
        count="anzahl",
    ).orderBy("tage_bis_auszahlung")


def records_per_transaction(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment
) -> DataFrame:
    """How many transactions have one, two, ... settlement records."""
    tx = report_transactions(tables, spaces, start, end)
    return (
        enrich.record_counts(tables, tx)
        .groupBy(F.col("records").alias("records_pro_transaktion"))
        .agg(F.count("*").alias("anzahl_transaktionen"))
        .orderBy("records_pro_transaktion")
    )


def _with_record_flag(tables: Tables, tx: DataFrame) -> DataFrame:
    side = enrich.has_record(tables, tx).withColumnRenamed("transaction_id", "id")
    return tx.join(side, "id", "left")


def settlement_coverage(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment
) -> DataFrame:
    """Transactions with and without any settlement record."""
    tx = report_transactions(tables, spaces, start, end)
    return _with_record_flag(tables, tx).agg(
        F.count("*").alias("anzahl_transaktionen"),
        F.count("has_record").alias("anzahl_mit_record"),
        (F.count("*") - F.count("has_record")).alias("anzahl_ohne_record"),
    )


def fee_record_matrix(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment
) -> DataFrame:
    """Transactions by whether they carry a fee and whether a record exists."""
    tx = report_transactions(tables, spaces, start, end)
    fee = F.col("totalappliedfees")
    return (
        _with_record_flag(tables, tx)
        .groupBy(
            F.when(fee.isNull() | (fee == 0), "ohne Gebuehr")
            .otherwise("mit Gebuehr")
            .alias("gebuehr"),
            F.when(F.col("has_record").isNull(), "ohne Record")
            .otherwise("mit Record")
            .alias("settlement"),
        )
        .agg(F.count("*").alias("anzahl"))
        .orderBy("gebuehr", "settlement")
    )


def withdrawal_count(tables: Tables, start: Moment, end: Moment) -> DataFrame:
    """Withdrawals of the whole platform in the period."""
    return within(tables.currentaccountwithdrawal, "createdon", start, end).agg(
        F.count("*").alias("anzahl_auszahlungen"),
        F.min("createdon").alias("frueheste"),
        F.max("createdon").alias("spaeteste"),
    )


def withdrawal_count_account(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment
) -> DataFrame:
    """Withdrawals of the accounts of the spaces. Each withdrawal counts once, however
    many of the spaces belong to its account."""
    return enrich.account_withdrawals(tables, spaces, start, end).agg(
        F.count("*").alias("anzahl_auszahlungen"),
        F.countDistinct("accountid").alias("anzahl_accounts"),
        F.min("createdon").alias("frueheste"),
        F.max("createdon").alias("spaeteste"),
    )


def settlement_record_count(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment
) -> DataFrame:
    tx = report_transactions(tables, spaces, start, end)
    return enrich.record_counts(tables, tx).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("settle_records")
    )


def bank_reference_sample(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment, rows: int | None = None
) -> DataFrame:
    """A look at bank references and payment dates; ordered so that it can be repeated."""
    found = (
        enrich.bank_rows(tables, report_transactions(tables, spaces, start, end))
        .select("transaction_id", "banktransaction_id", "reference", "paymentdate")
        .orderBy("transaction_id", "banktransaction_id")
    )
    return found if rows is None else found.limit(rows)


def lineitem_types(tables: Tables, spaces: Sequence[int]) -> DataFrame:
    """Line item types over the whole history of the spaces; no time filter on purpose."""
    li = tables.lineitem
    return (
        li.filter(one_of(li.spaceid, spaces))
        .groupBy("type")
        .agg(F.count("*").alias("anzahl_lineitems"), total(li.amountincludingtax).alias("summe"))
        .orderBy(F.desc("anzahl_lineitems"))
    )


def tip_inclusion_check(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment, rows: int | None = None
) -> DataFrame:
    """Does the gross amount contain the tip? Gross minus all line items, tipped sales only.

    The line items are summed per transaction before they meet it, so a transaction with
    very many of them arrives as one row.
    """
    tx = report_transactions(tables, spaces, start, end).select("id", "spaceid", "completedamount")
    li = tables.lineitem.filter(one_of(F.col("spaceid"), spaces)).select(
        F.col("id").alias("lineitems_id"), "spaceid", "type", "amountincludingtax"
    )
    bridge = tables.transaction_lineitem.filter(one_of(F.col("spaceid"), spaces)).join(
        tx.select(F.col("id").alias("transaction_id"), "spaceid"), ["transaction_id", "spaceid"], "left_semi"
    )
    amount = F.col("amountincludingtax")
    sums = (
        bridge.join(li, ["lineitems_id", "spaceid"])
        .groupBy(F.col("transaction_id").alias("id"), "spaceid")
        .agg(
            total(F.when(F.col("type") == "TIP", amount).otherwise(0)).alias("tip"),
            total(amount).alias("lineitems_total"),
        )
        .filter(F.col("tip") > 0)
    )
    found = (
        tx.join(sums, ["id", "spaceid"])
        .select(
            "id",
            "completedamount",
            "tip",
            "lineitems_total",
            (F.col("completedamount") - F.col("lineitems_total"))
            .cast(TOTAL)
            .alias("differenz_brutto_zu_lineitems"),
        )
        .orderBy("id")
    )
    return found if rows is None else found.limit(rows)

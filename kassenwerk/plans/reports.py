"""The five report queries and the historic payout sample."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.functions.money import total, total_or_zero
from kassenwerk.operators import enrich
from kassenwerk.operators.filters import (
    Moment,
    at_terminals,
    card_ends_with,
    report_transactions,
)
from kassenwerk.operators.timeline import following_events
from kassenwerk.schema import MONEY, TOTAL
from kassenwerk.session import written
from kassenwerk.sources.tables import Tables


def _ordered(df: DataFrame, ordered: bool, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys) if ordered else df


def _revenue(
    tables: Tables,
    tx: DataFrame,
    spaces: Sequence[int],
    by_terminal: bool,
) -> DataFrame:
    """Revenue per space, brand and currency, optionally per terminal.

    The transactions are first summed per configuration (and terminal) id and only the few
    resulting rows meet the dimension tables, so neither a dominant connector nor missing
    terminal ids can skew a join on the fact table.
    """
    fee, gross = F.col("totalappliedfees"), F.col("completedamount")
    waiting = (fee.isNull() | (fee == 0)) & F.col("has_record").isNull()
    ids = ["spaceid", "currency", "paymentconnectorconfiguration_id"]
    if by_terminal:
        ids.append("terminal_id")
    joined = tx.join(
        enrich.tips(tables, tx, spaces).withColumnRenamed("transaction_id", "id"), "id", "left"
    ).join(enrich.has_record(tables, tx).withColumnRenamed("transaction_id", "id"), "id", "left")
    summed = joined.groupBy(*ids).agg(
        F.count("*").alias("n"),
        F.sum(F.when(waiting, 1).otherwise(0)).alias("unsettled"),
        total(gross).alias("gross"),
        total(fee).alias("fees"),
        total(F.col("tip_amount")).alias("tip"),
    )
    named = enrich.with_brand(tables, summed)
    keys = [F.col("spaceid").alias("space_id"), "brand", F.col("currency").alias("waehrung")]
    if by_terminal:
        named = enrich.with_terminal(tables, named)
        keys[1:1] = ["terminal_identifier", "terminal_name"]
    fees = F.sum("fees")
    return named.groupBy(*keys).agg(
        F.sum("n").alias("anzahl_transaktionen"),
        F.sum("unsettled").alias("unsettled_anzahl"),
        total(F.col("gross")).alias("brutto_gross"),
        fees.cast(TOTAL).alias("transaction_fee_total"),
        (F.sum("gross") - F.coalesce(fees, F.lit(0))).cast(TOTAL).alias("netto"),
        total_or_zero(F.col("tip")).alias("tip_total"),
    )


def brand_report(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment, ordered: bool = True
) -> DataFrame:
    """Revenue, fees, net, tips and unsettled count per space, brand and currency."""
    tx = report_transactions(tables, spaces, start, end)
    rows = _revenue(tables, tx, spaces, by_terminal=False)
    return _ordered(rows, ordered, "space_id", "brand", "waehrung")


def terminal_report(
    tables: Tables,
    spaces: Sequence[int],
    start: Moment,
    end: Moment,
    terminals: Sequence[str],
    ordered: bool = True,
) -> DataFrame:
    """Brand report per terminal. Naming terminals is mandatory: none named, none reported."""
    tx = at_terminals(tables, report_transactions(tables, spaces, start, end), terminals)
    rows = _revenue(tables, tx, spaces, by_terminal=True)
    return _ordered(rows, ordered, "space_id", "terminal_identifier", "brand", "waehrung")


@dataclass(frozen=True)
class ExportColumn:
    alias: str
    value: Callable[[], Column]
    side: str | None = None
    default: bool = True


def _fees() -> Column:
    return F.coalesce("totalappliedfees", F.lit(0)).cast(MONEY)


def _tip() -> Column:
    return F.coalesce("tip_amount", F.lit(0)).cast(TOTAL)


def _plain(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


# Selectable columns by key. ``side`` names the join a column needs; a side no selected
# column needs is not part of the plan.
EXPORT_COLUMNS: dict[str, ExportColumn] = {
    "spaceid": ExportColumn("space_id", _plain("spaceid")),
    "createdon": ExportColumn("createdon", _plain("createdon")),
    "completedon": ExportColumn("completedon", _plain("completedon")),
    "state": ExportColumn("state", _plain("state")),
    "currency": ExportColumn("currency", _plain("currency")),
    "gross": ExportColumn("gross_amount", _plain("completedamount")),
    "fees": ExportColumn("processing_fees", _fees),
    "net": ExportColumn("net_amount", lambda: (F.col("completedamount") - _fees()).cast(MONEY)),
    "connectorname": ExportColumn("payment_connector_name", _plain("brand"), "brand"),
    "connector": ExportColumn("connector", _plain("connector"), "brand"),
    "terminal": ExportColumn("terminal_identifier", _plain("terminal_identifier"), "terminal"),
    "terminalname": ExportColumn("terminal_name", _plain("terminal_name"), "terminal"),
    "terminalid": ExportColumn("terminal_id", _plain("terminal_id")),
    "merchantref": ExportColumn("merchant_reference", _plain("merchantreference")),
    "payoutdate": ExportColumn("auszahlungsdatum", _plain("valuedate"), "settle"),
    "payoutref": ExportColumn(
        "settlement_reference", _plain("settlement_reference"), "payout", default=False
    ),
    "maskedcard": ExportColumn("masked_card", _plain("masked_card"), "card"),
    "authcode": ExportColumn("auth_code", _plain("auth_code"), "card"),
    "settlestate": ExportColumn("settlement_state", _plain("settlement_state"), "settle"),
    "tip": ExportColumn("tip_amount", _tip, "tip", default=False),
    "grossnotip": ExportColumn(
        "gross_excl_tip",
        lambda: (F.col("completedamount") - _tip()).cast(TOTAL),
        "tip",
        default=False,
    ),
}
DEFAULT_COLUMNS = tuple(key for key, column in EXPORT_COLUMNS.items() if column.default)


def transaction_export(
    tables: Tables,
    spaces: Sequence[int],
    start: Moment,
    end: Moment,
    terminals: Sequence[str] = (),
    columns: Collection[str] = DEFAULT_COLUMNS,
    ordered: bool = True,
) -> DataFrame:
    """One row per transaction with the chosen columns and only the joins they need.

    A job keeps the shuffles of all its steps on disk until it ends. An ordered export is computed whole before its first
    row is known, so over stored tables every side, and the rows before they are sorted, are a job of their own that
    leaves narrow rows and no shuffle.
    """
    unknown = sorted(set(columns) - EXPORT_COLUMNS.keys())
    if unknown:
        raise ValueError(f"unknown export columns: {', '.join(unknown)}")
    chosen = [column for key, column in EXPORT_COLUMNS.items() if key in columns]
    sides = {column.side for column in chosen}
    tx = report_transactions(tables, spaces, start, end)
    if terminals:
        tx = at_terminals(tables, tx, terminals)

    def per_transaction(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side.withColumnRenamed("transaction_id", "id"), "id", "left")

    staged = ordered and tables.by_transaction

    def apart(part: DataFrame, label: str) -> DataFrame:
        return written(part, label) if staged else part

    rows = tx
    if "tip" in sides:
        rows = per_transaction(rows, apart(enrich.tips(tables, tx, spaces), "tips"))
    if "card" in sides:
        rows = per_transaction(rows, apart(enrich.cards(tables, tx, spaces), "cards"))
    if sides & {"settle", "payout"}:
        dates = enrich.value_dates(tables, tx)
        if {"settle", "payout"} <= sides and (staged or not tables.by_transaction):
            # Small without the bank's ids, so both sides read it instead of joining records and bank twice.
            dates = written(dates, "value-dates")
    if "settle" in sides:
        rows = per_transaction(rows, apart(enrich.settlement_dates(dates), "settlements"))
    if "payout" in sides:
        withdrawals = enrich.account_withdrawals(
            tables, spaces, start, end, enrich.PAYOUT_WINDOW_DAYS
        )
        rows = per_transaction(rows, apart(enrich.payout_references(tables, tx, withdrawals, dates=dates), "payouts"))
    if "brand" in sides:
        rows = enrich.with_brand(tables, rows, tx)
    if "terminal" in sides:
        rows = enrich.with_terminal(tables, rows)
    return _ordered(apart(rows, "export"), ordered, "spaceid", "completedon", "id").select(
        *[column.value().alias(column.alias) for column in chosen]
    )


def card_search(
    tables: Tables,
    spaces: Sequence[int],
    start: Moment,
    end: Moment,
    last4: str,
    terminals: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Transactions paid with a card that ends with these digits, newest first."""
    tx = report_transactions(tables, spaces, start, end)
    if terminals:
        tx = at_terminals(tables, tx, terminals)
    found = enrich.cards(tables, tx, spaces).filter(card_ends_with(F.col("masked_card"), last4))
    rows = tx.join(found.withColumnRenamed("transaction_id", "id"), "id")
    rows = enrich.with_terminal(tables, enrich.with_brand(tables, rows, tx))
    return _ordered(rows, ordered, F.desc("completedon"), "id").select(
        F.col("spaceid").alias("space_id"),
        "completedon",
        "terminal_identifier",
        "terminal_name",
        F.col("completedamount").alias("gross_amount"),
        F.col("currency").alias("waehrung"),
        "brand",
        "masked_card",
        "auth_code",
        F.col("id").alias("transaction_id"),
        "state",
    )


def settlement_transactions(
    tables: Tables,
    start: Moment,
    end: Moment,
    account: int | None = None,
    with_account: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """One row per transaction of the period with its settlement; no space or terminal filter.

    ``account`` restricts to the spaces of one account, ``with_account`` adds
    ``account_id`` so that a report can cover all accounts in one job.
    """
    tx = report_transactions(tables, None, start, end)
    if account is not None or with_account:
        tx = enrich.with_account(tables, tx)
    if account is not None:
        tx = tx.filter(F.col("accountid") == account)
    sides = enrich.settlements(tables, tx).withColumnRenamed("transaction_id", "id")
    rows = enrich.with_terminal(tables, enrich.with_brand(tables, tx.join(sides, "id", "left"), tx))
    chosen = [
        F.to_date("valuedate").alias("settlement_datum"),
        F.coalesce("settlement_state", F.lit("NO_RECORD")).alias("settlement_state"),
        F.col("id").alias("transaction_id"),
        F.col("merchantreference").alias("merchant_reference"),
        F.col("spaceid").alias("space_id"),
        F.col("currency").alias("waehrung"),
        F.col("brand").alias("connector"),
        F.when(F.col("terminal_id").isNotNull(), "Physical Terminal")
        .otherwise("Ecommerce")
        .alias("sales_channel"),
        F.col("terminal_identifier"),
        F.col("completedamount").alias("brutto_gross"),
        F.col("settlement_gross"),
        F.col("processing_fees"),
        F.col("netamount"),
        F.coalesce("settlement_records", F.lit(0)).alias("settlement_records"),
    ]
    if with_account:
        chosen.insert(0, F.col("accountid").alias("account_id"))
    return _ordered(rows.select(*chosen), ordered, "settlement_datum", "transaction_id")


def settlement_reference_sample(
    tables: Tables, spaces: Sequence[int], start: Moment, end: Moment, ordered: bool = True
) -> DataFrame:
    """Historic export: the first withdrawal of any account at or after the value date.

    Kept to compare with old results; it has neither a window nor an account scope. The
    reference of a transaction is the one found for its latest value date.
    """
    tx = report_transactions(tables, spaces, start, end)
    settled = (
        enrich.bank_rows(tables, tx)
        .filter("state = 'SETTLED'")
        .groupBy("transaction_id")
        .agg(F.max("valuedate").alias("auszahlungsdatum"))
    )
    following = following_events(
        settled,
        tables.currentaccountwithdrawal,
        scope=[],
        at="auszahlungsdatum",
        event_at="createdon",
        ties=["internalreference"],
    )
    # Unanswered rows take a number of their own, which spreads them over all tasks.
    nothing = -1 - F.abs(F.xxhash64("transaction_id") % 1_000_000_007)
    settle = (
        following.probes.withColumn("event", F.coalesce("event", nothing))
        .join(following.events.select("event", F.col("internalreference").alias("settlement_reference")), "event", "left")
        .select(F.col("transaction_id").alias("id"), "auszahlungsdatum", "settlement_reference")
    )
    card = enrich.cards(tables, tx, spaces).withColumnRenamed("transaction_id", "id")
    rows = tx.join(card, "id", "left").join(settle, "id", "left")
    rows = enrich.with_terminal(tables, enrich.with_brand(tables, rows, tx))
    base = [
        "spaceid", "createdon", "completedon", "state", "currency", "gross", "fees", "net",
        "connectorname", "connector", "terminal", "terminalname", "terminalid", "merchantref",
    ]
    return _ordered(rows, ordered, "spaceid", "completedon", "id").select(
        *[EXPORT_COLUMNS[key].value().alias(EXPORT_COLUMNS[key].alias) for key in base],
        "auszahlungsdatum",
        "settlement_reference",
        "masked_card",
        "auth_code",
    )

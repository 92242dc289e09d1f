"""Sides joined to a transaction, each reduced to one row per transaction first.

Every side is restricted to the report's transactions (``tx`` needs an ``id`` column) by a
semi-join. Where the aggregate is on the transaction id itself the semi-join is written
above it: Catalyst moves it down to the scan if the id list fits a broadcast, and otherwise
both share one shuffle that carries partial results only, however many rows one
transaction has. ``bank_rows`` are restricted first instead, because the join on the bank
transaction has to move them a second time.

Ids of bank transactions and line items are texts and make up most of what is shuffled. Tips and value dates
meet them before they are restricted, so that a text is moved once and not once for each join; only
tables that are bucketed by transaction are restricted first, for there it moves nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.functions.labels import (
    AUTH_CODE_LABEL,
    MASKED_CARD_LABEL,
    brand_name,
    label_text,
)
from kassenwerk.functions.money import total
from kassenwerk.operators.filters import Moment, one_of, within
from kassenwerk.operators.skew import lookup
from kassenwerk.operators.timeline import following_events
from kassenwerk.schema import LONG
from kassenwerk.sources.tables import Tables

PAYOUT_WINDOW_DAYS = 10


def of_report(side: DataFrame, tx: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Semi-join: rows of ``side`` that belong to a transaction of the report."""
    return side.join(tx.select(F.col("id").alias(key)), key, "left_semi")


def tips(tables: Tables, tx: DataFrame, spaces: Sequence[int] | None = None) -> DataFrame:
    """Tip per transaction. The tip is part of the gross amount, not on top of it."""
    bridge, items = tables.transaction_lineitem, tables.lineitem.filter("type = 'TIP'")
    if spaces is not None:
        bridge = bridge.filter(one_of(F.col("spaceid"), spaces))
        items = items.filter(one_of(F.col("spaceid"), spaces))
    if tables.by_transaction:
        bridge = of_report(bridge, tx)
    items = items.select(F.col("id").alias("lineitems_id"), "spaceid", "amountincludingtax")
    summed = (
        bridge.join(items, ["lineitems_id", "spaceid"])
        .groupBy("transaction_id")
        .agg(total(F.col("amountincludingtax")).alias("tip_amount"))
    )
    return summed if tables.by_transaction else of_report(summed, tx)


def record_counts(tables: Tables, tx: DataFrame) -> DataFrame:
    """Settlement records per transaction that has any."""
    counted = tables.payfacsettlementrecord.groupBy("transaction_id").agg(
        F.count("*").alias("records")
    )
    return of_report(counted, tx)


def has_record(tables: Tables, tx: DataFrame) -> DataFrame:
    """Transactions with at least one settlement record, each once."""
    known = tables.payfacsettlementrecord.select("transaction_id").distinct()
    return of_report(known, tx).withColumn("has_record", F.lit(True))


def bank_rows(tables: Tables, tx: DataFrame) -> DataFrame:
    """Settlement records of the report with their bank transaction."""
    bank = tables.banktransaction.withColumnRenamed("id", "banktransaction_id")
    return of_report(tables.payfacsettlementrecord, tx).join(bank, "banktransaction_id")


def value_dates(tables: Tables, tx: DataFrame) -> DataFrame:
    """States and value dates of the report's bank transactions, each once per transaction."""
    records = tables.payfacsettlementrecord
    if tables.by_transaction:
        records = of_report(records, tx)
    bank = tables.banktransaction.select(F.col("id").alias("banktransaction_id"), "state", "valuedate")
    # Dealt out by transaction, which serves both the aggregate and the semi-join.
    dated = (
        records.join(bank, "banktransaction_id")
        .select("transaction_id", "state", "valuedate")
        .repartition("transaction_id")
        .distinct()
    )
    return dated if tables.by_transaction else of_report(dated, tx)


def settlement_state(state: Column) -> Column:
    """PARTIAL / SETTLED / UPCOMING over all bank rows of a transaction.

    Counted rather than taken at the latest value date: a bank row without a value date
    would drop out of a ``max_by`` and hide an open part.
    """
    settled, other = F.count_if(state == "SETTLED"), F.count_if(state != "SETTLED")
    return (
        F.when((settled > 0) & (other > 0), "PARTIAL")
        .when(settled > 0, "SETTLED")
        .otherwise("UPCOMING")
    )


def settlements(tables: Tables, tx: DataFrame) -> DataFrame:
    """State, value date and bank amounts per transaction; the fee is posting minus value."""
    posting, value = F.col("postingamount"), F.col("valueamount")
    return (
        bank_rows(tables, tx)
        .groupBy("transaction_id")
        .agg(
            settlement_state(F.col("state")).alias("settlement_state"),
            F.max("valuedate").alias("valuedate"),
            total(posting).alias("settlement_gross"),
            total(posting - value).alias("processing_fees"),
            total(value).alias("netamount"),
            F.count("*").alias("settlement_records"),
        )
    )


def settlement_dates(dates: DataFrame) -> DataFrame:
    """State and latest value date per transaction, from its ``value_dates``."""
    return dates.groupBy("transaction_id").agg(
        settlement_state(F.col("state")).alias("settlement_state"), F.max("valuedate").alias("valuedate")
    )


def cards(tables: Tables, tx: DataFrame, spaces: Sequence[int] | None = None) -> DataFrame:
    """Masked card and authorisation code of the latest charge attempt.

    The latest attempt is found on ids alone, so that the aggregate can hash. The two texts are
    taken out of the labels before the join: they are a small part of what it would have to move.
    """
    attempts = tables.chargeattempt
    if spaces is not None:
        attempts = attempts.filter(one_of(F.col("spaceid"), spaces))
    attempts = attempts.withColumnRenamed("id", "attempt_id")
    charges = of_report(tables.charge, tx).select(F.col("id").alias("charge_id"), "transaction_id")
    latest = (
        charges.join(attempts.select("attempt_id", "charge_id"), "charge_id")
        .groupBy("transaction_id")
        .agg(F.max("attempt_id").alias("attempt_id"))
    )
    texts = attempts.select(
        "attempt_id",
        label_text(F.col("labels"), MASKED_CARD_LABEL).alias("masked_card"),
        label_text(F.col("labels"), AUTH_CODE_LABEL).alias("auth_code"),
    )
    return latest.join(texts, "attempt_id").select("transaction_id", "masked_card", "auth_code")


def with_account(tables: Tables, tx: DataFrame) -> DataFrame:
    """Transactions with their space's account; spaces without one keep their sales, account NULL.

    A space listed several times has one account, the smallest, so that it counts once.
    """
    one = tables.spacereference.groupBy("spaceid").agg(F.min("accountid").alias("accountid"))
    return lookup(tx, one, ["spaceid"])


def account_withdrawals(
    tables: Tables, spaces: Sequence[int] | None, start: Moment, end: Moment, extra_days: int = 0
) -> DataFrame:
    """Withdrawals of the accounts the spaces belong to, in an absolute window.

    The table holds the withdrawals of every account; without the account scope a
    payout could be matched to somebody else's. The window prunes the scan.
    """
    sr = tables.spacereference
    if spaces is not None:
        sr = sr.filter(one_of(sr.spaceid, spaces))
    bounded = within(tables.currentaccountwithdrawal, "createdon", start, end, extra_days)
    return bounded.join(sr.select("accountid"), "accountid", "left_semi")


def payout_references(
    tables: Tables,
    tx: DataFrame,
    withdrawals: DataFrame,
    within_days: int | None = PAYOUT_WINDOW_DAYS,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Per transaction the earliest withdrawal that follows one of its settled bank rows.

    ``within_days=None`` leaves the search open-ended; ``dates`` are the report's ``value_dates``, if they are known.
    """
    if dates is None:
        dates = value_dates(tables, tx)
    accounts = with_account(tables, tx.select("id", "spaceid")).select(
        F.col("id").alias("transaction_id"), F.col("accountid").cast(LONG).alias("accountid")
    )
    settled = (
        dates.filter("state = 'SETTLED' AND valuedate IS NOT NULL")
        .join(accounts, "transaction_id")
        .select("transaction_id", "accountid", "valuedate")
    )
    following = following_events(
        settled,
        withdrawals,
        scope=["accountid"],
        at="valuedate",
        event_at="createdon",
        ties=["internalreference"],
        within_days=within_days,
    )
    # Numbers only up to here, so that the aggregate over all bank rows can hash. Later events have lower numbers.
    earliest = following.probes.filter("event IS NOT NULL").groupBy("transaction_id").agg(F.max("event").alias("event"))
    return earliest.join(following.events, "event").select(
        "transaction_id", F.col("internalreference").alias("settlement_reference")
    )


def with_brand(tables: Tables, rows: DataFrame, seen_in: DataFrame | None = None) -> DataFrame:
    """Add ``brand`` and ``connector``; the configuration is unique only per space.

    ``seen_in`` are the rows before they were joined to others, if they were.
    """
    pcc = tables.paymentconnectorconfiguration.select(
        F.col("id").alias("paymentconnectorconfiguration_id"),
        "spaceid",
        "connector",
        F.col("name").alias("_configured"),
    )
    pc = tables.paymentconnector.select(F.col("id").alias("connector"), F.col("name").alias("_names"))
    # The few connectors meet the configurations, not the rows.
    configured = pcc.join(pc, "connector", "left")
    return (
        lookup(rows, configured, ["paymentconnectorconfiguration_id", "spaceid"], seen_in)
        .withColumn("brand", brand_name(F.col("_names"), F.col("_configured")))
        .drop("_names", "_configured")
    )


def with_terminal(tables: Tables, rows: DataFrame) -> DataFrame:
    """Add the terminal's identifier and name.

    Sales without a terminal match none. They take their own id as key, which spreads them
    over all tasks instead of sending them to that of the NULL key.
    """
    pt = tables.paymentterminal.select(
        F.col("id").alias("_terminal"),
        F.col("spaceid").alias("_space"),
        F.col("identifier").alias("terminal_identifier"),
        F.col("name").alias("terminal_name"),
    )
    terminal = F.col("terminal_id")
    key = F.coalesce(terminal, F.xxhash64("id")) if "id" in rows.columns else terminal
    same = (key == F.col("_terminal")) & (F.col("spaceid") == F.col("_space")) & terminal.isNotNull()
    return rows.join(pt, same, "left").drop("_terminal", "_space")

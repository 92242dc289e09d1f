"""Types of the payment tables and of the report rows."""

from __future__ import annotations

from pyspark.sql import types as T

# Amounts carry eight decimals and are never held as floating point. Per-row amounts
# use MONEY; anything summed uses TOTAL, so that a sum over very many rows still fits.
MONEY = T.DecimalType(20, 8)
TOTAL = T.DecimalType(38, 8)

LONG = T.LongType()
TEXT = T.StringType()
STAMP = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


TABLES: dict[str, T.StructType] = {
    "transaction": _struct(
        id=LONG,
        spaceid=LONG,
        createdon=STAMP,
        completedon=STAMP,
        state=TEXT,
        currency=TEXT,
        completedamount=MONEY,
        totalappliedfees=MONEY,
        paymentconnectorconfiguration_id=LONG,
        terminal_id=LONG,
        merchantreference=TEXT,
    ),
    "paymentconnectorconfiguration": _struct(id=LONG, spaceid=LONG, connector=LONG, name=TEXT),
    "paymentconnector": _struct(id=LONG, name=T.MapType(TEXT, TEXT)),
    "paymentterminal": _struct(id=LONG, spaceid=LONG, identifier=TEXT, name=TEXT),
    "charge": _struct(id=LONG, transaction_id=LONG),
    "chargeattempt": _struct(
        id=LONG, charge_id=LONG, spaceid=LONG, labels=T.ArrayType(T.MapType(TEXT, TEXT))
    ),
    "payfacsettlementrecord": _struct(transaction_id=LONG, banktransaction_id=TEXT),
    "banktransaction": _struct(
        id=TEXT,
        state=TEXT,
        valuedate=STAMP,
        postingamount=MONEY,
        valueamount=MONEY,
        reference=TEXT,
        paymentdate=STAMP,
    ),
    "currentaccountwithdrawal": _struct(internalreference=TEXT, createdon=STAMP, accountid=LONG),
    "spacereference": _struct(spaceid=LONG, accountid=LONG),
    "transaction_lineitem": _struct(transaction_id=LONG, lineitems_id=TEXT, spaceid=LONG),
    "lineitem": _struct(id=TEXT, spaceid=LONG, type=TEXT, amountincludingtax=MONEY),
}

TERMINAL_ROW = _struct(
    terminal_identifier=TEXT,
    terminal_name=TEXT,
    brand=TEXT,
    waehrung=TEXT,
    anzahl_transaktionen=LONG,
    unsettled_anzahl=LONG,
    brutto_gross=MONEY,
    tip_total=MONEY,
)

SETTLEMENT_ROW = _struct(
    settlement_datum=T.DateType(),
    settlement_state=TEXT,
    transaction_id=TEXT,
    merchant_reference=TEXT,
    space_id=LONG,
    waehrung=TEXT,
    connector=TEXT,
    sales_channel=TEXT,
    terminal_identifier=TEXT,
    brutto_gross=MONEY,
    settlement_gross=MONEY,
    processing_fees=MONEY,
    netamount=MONEY,
    settlement_records=LONG,
)

"""Settlement report: what has been paid out, what is pending, what is still open.

``rows`` are those of ``settlement_transactions`` (or the CSV source). ``scope`` names
leading columns, such as ``account_id``, to report on many accounts in one job; every
result then carries these columns. Amounts of several currencies are never added: a scope
with a second currency has no amounts and is refused, the other scopes are reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.functions.dates import report_end_day
from kassenwerk.functions.money import total
from kassenwerk.operators.numbering import number_within
from kassenwerk.schema import MONEY, TOTAL
from kassenwerk.session import written

# Row states of the report.
SETTLED, PENDING, OPEN = "Settled", "Ausstehend", "Offen"

Scope = Sequence[str]


def row_status(day: Column, state: Column, end: str | None) -> Column:
    """Open without a record or value date, pending after the report's last day, else settled."""
    open_row = day.isNull() | (state == "NO_RECORD")
    late = day > report_end_day(F.lit(end or ""))
    return F.when(open_row, OPEN).when(late, PENDING).otherwise(SETTLED)


def classified(rows: DataFrame, end: str | None, scope: Scope = ()) -> DataFrame:
    """Rows with status and the amounts the report counts.

    Amounts come from the bank side so that gross - fees = net; only a transaction without
    a record shows its own amount as gross.
    """
    zero = F.lit(0).cast(MONEY)
    state = F.col("settlement_state")
    status = row_status(F.col("settlement_datum"), state, end)
    return rows.select(
        *scope,
        status.alias("status"),
        F.when(status != OPEN, F.col("settlement_datum")).alias("datum"),
        "transaction_id",
        "connector",
        "waehrung",
        F.when(state == "NO_RECORD", F.col("brutto_gross"))
        .otherwise(F.coalesce("settlement_gross", zero))
        .alias("brutto"),
        F.coalesce("processing_fees", zero).alias("fees"),
        F.coalesce("netamount", zero).alias("netto"),
    )


def _of_currencies(summed: DataFrame, scope: Scope) -> DataFrame:
    """``summed`` with all currencies of its scope; where there are several, amounts are NULL.

    ``summed`` is already aggregated (days or connectors), so the window stays small, and
    collecting distinct currency lists keeps what each row carries small as well.
    """
    everything = F.sort_array(
        F.array_distinct(F.flatten(F.collect_set("waehrungen").over(Window.partitionBy(*scope))))
    )
    one = F.size("waehrungen") <= 1
    return summed.withColumn("waehrungen", everything).withColumns(
        {c: F.when(one, F.col(c)) for c in ("brutto", "fees", "netto")}
    )


def refusals(sums: DataFrame, scope: Scope = ()) -> DataFrame:
    """Scopes with more than one currency, which are not reported: the currencies and the message."""
    listed = sums.groupBy(*scope).agg(F.sort_array(F.collect_set("waehrung")).alias("waehrungen"))
    message = F.concat(
        F.lit("settlement report covers several currencies (Währungen): "),
        F.array_join("waehrungen", ", "),
    )
    return listed.filter(F.size("waehrungen") > 1).withColumn("meldung", message)


def accepted(sums: DataFrame, scope: Scope = ()) -> DataFrame:
    """The sums of all scopes that are not refused; a scope's sums are bounded by the calendar."""
    currencies = F.collect_set("waehrung").over(Window.partitionBy(*scope))
    return sums.withColumn("_all", currencies).filter(F.size("_all") <= 1).drop("_all")


def _measures() -> list[Column]:
    return [
        F.count("*").alias("anzahl_tx"),
        total(F.col("brutto")).alias("brutto"),
        total(F.col("fees")).alias("fees"),
        total(F.col("netto")).alias("netto"),
    ]


def cube(marked: DataFrame, scope: Scope = ()) -> DataFrame:
    """Classified rows summed per status, value date, payment method and currency.

    All figures of the report follow from this table, whose size is dates times payment
    methods, so a report with several outputs reads its transactions once. The currency is
    a key rather than a collected set, which keeps the aggregate over all rows hashing.
    """
    return marked.groupBy(*scope, "status", "datum", "connector", "waehrung").agg(*_measures())


def _summed_again() -> list[Column]:
    return [
        F.sum("anzahl_tx").alias("anzahl_tx"),
        *[total(F.col(c)).alias(c) for c in ("brutto", "fees", "netto")],
        F.sort_array(F.collect_set("waehrung")).alias("waehrungen"),
    ]


def overview(sums: DataFrame, scope: Scope = ()) -> DataFrame:
    """One row per settlement date plus one for everything open, numbered, open last."""
    days = sums.groupBy(*scope, "status", "datum").agg(*_summed_again())
    # One row per value date: the numbering window is bounded by the calendar.
    by_date = Window.partitionBy(*scope).orderBy(F.col("status") == OPEN, "datum")
    return (
        _of_currencies(days, scope)
        .withColumn("nr", F.row_number().over(by_date))
        .select(*scope, "nr", "datum", "status", "anzahl_tx", "brutto", "fees", "netto", "waehrungen")
        .orderBy(*scope, "nr")
    )


def _sum_where(condition: Column, column: str) -> Column:
    """The sum, 0 of no rows; NULL if one of the amounts is, because its scope is refused."""
    unknown = F.count_if(condition & F.col(column).isNull())
    return F.when(unknown == 0, F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)))


def kpis(settlements: DataFrame, scope: Scope = ()) -> DataFrame:
    """Key figures from the overview; open transactions count apart from paid ones."""
    dated, open_rows = F.col("status") != OPEN, F.col("status") == OPEN
    number = F.count_if(dated)
    net = _sum_where(dated, "netto").cast(TOTAL)
    average = F.when(number == 0, F.lit(0)).otherwise(net / number.cast("decimal(20,0)"))
    return settlements.groupBy(*scope).agg(
        number.alias("anzahl_settlements"),
        _sum_where(dated, "anzahl_tx").alias("anzahl_tx"),
        _sum_where(dated, "brutto").cast(TOTAL).alias("brutto"),
        _sum_where(dated, "fees").cast(TOTAL).alias("fees"),
        net.alias("netto"),
        average.cast(TOTAL).alias("avg_netto"),
        _sum_where(open_rows, "anzahl_tx").alias("offen_anzahl_tx"),
        _sum_where(open_rows, "brutto").cast(TOTAL).alias("offen_brutto"),
        F.sort_array(F.coalesce(F.max("waehrungen"), F.array().cast("array<string>"))).alias(
            "waehrungen"
        ),
    )


def pending(settlements: DataFrame, scope: Scope = ()) -> DataFrame:
    """Settlements whose value date lies after the report period."""
    late = F.col("status") == PENDING
    return settlements.groupBy(*scope).agg(
        F.count_if(late).alias("anzahl_settlements"),
        _sum_where(late, "anzahl_tx").alias("anzahl_tx"),
        _sum_where(late, "brutto").cast(TOTAL).alias("brutto"),
        _sum_where(late, "netto").cast(TOTAL).alias("netto"),
    )


def totals(settlements: DataFrame, scope: Scope = ()) -> DataFrame:
    """Column totals of the overview including the open row, so gross - fees may exceed net."""
    everything = F.lit(True)
    return settlements.groupBy(*scope).agg(
        _sum_where(everything, "anzahl_tx").alias("anzahl_tx"),
        *[
            _sum_where(everything, column).cast(TOTAL).alias(column)
            for column in ("brutto", "fees", "netto")
        ],
    )


def connectors(sums: DataFrame, scope: Scope = ()) -> DataFrame:
    """Paid and pending volume per payment method, largest first, open rows left out."""
    paid = (
        sums.filter(F.col("status") != OPEN).groupBy(*scope, "connector").agg(*_summed_again())
    )
    return _of_currencies(paid, scope).drop("waehrungen").orderBy(*scope, *by_volume())


def by_volume() -> list[Column]:
    """Gross descending, equal amounts by name in German order."""
    return [F.desc("brutto"), F.collate("connector", "de")]


def numbered_rows(marked: DataFrame, scope: Scope = ()) -> DataFrame:
    """Classified rows numbered by transaction id within their settlement.

    All open transactions form one settlement, often the largest; the numbering spreads
    it over many tasks.
    """
    ident = F.col("transaction_id")
    return number_within(
        marked, [*scope, "status", "datum"], [ident.try_cast("bigint"), ident.cast("string")]
    )


def detail(numbered: DataFrame, days: DataFrame, scope: Scope = ()) -> DataFrame:
    """Every transaction of every settlement with the settlement's number from the overview."""
    keys = [*scope, "status", "datum"]
    settlements = days.select(
        *[F.col(c).alias(f"_{c}") for c in keys], F.col("nr").alias("settlement_nr")
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return numbered.join(settlements, same).select(
        *scope,
        "settlement_nr",
        "datum",
        "status",
        "nr",
        "transaction_id",
        "connector",
        "brutto",
        "fees",
        "netto",
    )


@dataclass(frozen=True)
class SettlementReport:
    overview: DataFrame
    kpis: DataFrame
    connectors: DataFrame
    connector_total: DataFrame
    pending: DataFrame
    totals: DataFrame
    detail: DataFrame | None
    refused: DataFrame


def settlement_report(
    rows: DataFrame, end: str | None = None, with_detail: bool = True, scope: Scope = ()
) -> SettlementReport:
    """All parts of the report from one pass over ``rows``.

    The classified rows (with detail), their sums and the overview are written to the shared
    folder once and every part reads from there. A scope with a second currency is left
    out of all parts and stands in ``refused``; only the key figures name it, with its
    counts and currencies and without amounts.
    """
    marked = classified(rows, end, scope)
    if with_detail:
        marked = written(marked, "settlement-rows")
    every = written(cube(marked, scope), "settlement-sums")
    refused, sums = refusals(every, scope), accepted(every, scope)
    days = written(overview(sums, scope), "settlement-days").orderBy(*scope, "nr")
    methods = connectors(sums, scope)
    # Without a scope, an aggregate over nothing would still give a row.
    shut = not scope and not refused.isEmpty()
    kept = lambda df: df.filter(F.lit(not shut))
    return SettlementReport(
        overview=days,
        kpis=kpis(overview(every, scope), scope),
        connectors=methods,
        connector_total=kept(totals(methods, scope)),
        pending=kept(pending(days, scope)),
        totals=kept(totals(days, scope)),
        detail=detail(numbered_rows(marked, scope), days, scope) if with_detail else None,
        refused=refused,
    )

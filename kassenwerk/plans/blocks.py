"""Report blocks: named tables of text cells in a fixed order, ready for the CSV sink.

A block row is (block_no, block, row_no, kind, cells, types, note). Row 0 is the header;
its note is the block's remark. Amount cells hold plain numbers, not display text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.functions.dates import report_end_day, swiss_date
from kassenwerk.functions.money import plain_amount, swiss_amount, swiss_integer
from kassenwerk.plans import settlement_model as settle
from kassenwerk.plans import terminal_model as terminal
from kassenwerk.schema import TOTAL

# Block names, headers and cell types of the exports.
TEXT, NUMBER, AMOUNT = "text", "zahl", "betrag"
TERMINAL_BLOCKS = {
    terminal.OUTLET: ("Total Outlet-Gruppen", 1),
    terminal.BRAND_GROUP: ("Total Brand-Gruppen", 2),
    terminal.GRAND: ("Gesamttotal", 3),
    terminal.DETAIL: ("Detail", 4),
}
TERMINAL_MEASURES = ["Complete Demand", "Tip", "Unmatched", "Anz."]
TERMINAL_HEADERS = {
    terminal.OUTLET: ["Outlet-Gruppe", "Brand-Gruppe", *TERMINAL_MEASURES],
    terminal.BRAND_GROUP: ["Brand-Gruppe", *TERMINAL_MEASURES],
    terminal.GRAND: ["", *TERMINAL_MEASURES],
    terminal.DETAIL: ["Outlet-Gruppe", "TID", "Terminal", "Brand", "Brand-Gruppe", *TERMINAL_MEASURES],
}
SUMMARY_BLOCK = "Zusammenfassung"
CONNECTOR_BLOCK = "Aufschlüsselung nach Zahlungsmittel"
OVERVIEW_BLOCK = "Settlement-Übersicht"
SUMMARY_HEADER = ["Kennzahl", "Wert"]
CONNECTOR_HEADER = ["Zahlungsmittel", "Tx", "Brutto", "Fees", "Netto"]
OVERVIEW_HEADER = ["#", "Settlement Datum", "Tx", "Brutto", "Fees", "Netto", "Status"]
DETAIL_HEADER = ["#", "Transaction ID", "Connector", "Brutto", "Fees", "Netto"]
FIRST_DETAIL_BLOCK = 4

HEADER, ROW, TOTAL_ROW = "header", "row", "total"


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _block(
    df: DataFrame,
    scope: Sequence[str],
    block_no: Column,
    block: Column,
    row_no: Column,
    kind: str,
    cells: Sequence[Column],
    types: Sequence[str] | Column,
    note: Column | None = None,
) -> DataFrame:
    return df.select(
        *scope,
        block_no.cast("bigint").alias("block_no"),
        block.alias("block"),
        row_no.cast("bigint").alias("row_no"),
        F.lit(kind).alias("kind"),
        F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("cells"),
        (types if isinstance(types, Column) else _texts(types)).alias("types"),
        (note if note is not None else F.lit("")).alias("note"),
    )


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def terminal_export_blocks(report: DataFrame) -> DataFrame:
    """Outlet totals, brand group totals, grand total, detail, in that order.

    ``report`` comes from ``terminal_group_report``; if it is split by currency, each
    currency has its own stack of blocks. The order inside a block is carried by the
    ``sort_`` columns, see ``in_block_order``.
    """
    scope = ["waehrung"] if "waehrung" in report.columns else []
    money = [plain_amount(F.col("complete_demand")), plain_amount(F.col("tip"))]
    counts = [F.col("unmatched"), F.col("count")]
    leading = {
        terminal.OUTLET: [F.col("outlet"), F.col("brand_group")],
        terminal.BRAND_GROUP: [F.col("brand_group")],
        terminal.GRAND: [F.lit("Total")],
        terminal.DETAIL: [F.col(c) for c in ("outlet", "tid", "name", "brand", "brand_group")],
    }

    def per_level(choose: Callable[[str], Column]) -> Column:
        return F.coalesce(
            *[F.when(F.col("level") == level, choose(level)) for level in TERMINAL_BLOCKS]
        )

    def cells(level: str) -> Column:
        texts = [F.coalesce(c.cast("string"), F.lit("")) for c in [*leading[level], *money, *counts]]
        return F.array(*texts)

    def types(level: str) -> Column:
        return _texts([TEXT] * len(leading[level]) + [AMOUNT, AMOUNT, NUMBER, NUMBER])

    kind = F.when(F.col("level") == terminal.GRAND, TOTAL_ROW).otherwise(ROW)
    rows = report.select(
        *scope,
        per_level(lambda level: F.lit(TERMINAL_BLOCKS[level][1])).cast("bigint").alias("block_no"),
        per_level(lambda level: F.lit(TERMINAL_BLOCKS[level][0])).alias("block"),
        F.lit(1).cast("bigint").alias("row_no"),
        kind.alias("kind"),
        per_level(cells).alias("cells"),
        per_level(types).alias("types"),
        F.lit("").alias("note"),
        *[F.col(c).alias(f"sort_{c}") for c in ("outlet", "brand_group", "name", "tid", "brand")],
    )
    heads = report.filter(F.col("level") == terminal.GRAND).select(
        *scope,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(number).cast("bigint").alias("block_no"),
                        F.lit(name).alias("block"),
                        _texts(TERMINAL_HEADERS[level]).alias("cells"),
                    )
                    for level, (name, number) in TERMINAL_BLOCKS.items()
                ]
            )
        ).alias("head"),
    ).select(
        *scope,
        "head.block_no",
        "head.block",
        F.lit(0).cast("bigint").alias("row_no"),
        F.lit(HEADER).alias("kind"),
        "head.cells",
        F.transform("head.cells", lambda _: F.lit(TEXT)).alias("types"),
        F.lit("").alias("note"),
    )
    return rows.unionByName(heads, allowMissingColumns=True)


def in_block_order(blocks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Blocks and rows in reading order; names sort as in German."""
    names = [c for c in ("sort_outlet", "sort_brand_group", "sort_name") if c in blocks.columns]
    ids = [c for c in ("sort_tid", "sort_brand") if c in blocks.columns]
    return blocks.orderBy(
        *scope, "block_no", "row_no", *[F.collate(c, "de") for c in names], *ids
    )


def overview_note(pending: str, end: str | None) -> Column:
    """Remark under the overview: pending settlements and/or transactions without record."""
    days = swiss_date(report_end_day(F.lit(end or "")))
    until = F.coalesce(F.concat(F.lit("nach dem "), days), F.lit("nach dem Berichtszeitraum"))
    n, tx, open_tx = (F.col(f"{pending}.{c}") for c in ("n", "tx", "open_tx"))
    return F.concat_ws(
        " ",
        F.when(
            n > 0,
            F.concat(
                n.cast("string"), F.lit(" Settlement(s) mit "), tx.cast("string"),
                F.lit(" Transaktionen werden erst "), until, F.lit(" abgerechnet."),
            ),
        ),
        F.when(
            open_tx > 0,
            F.concat(
                open_tx.cast("string"),
                F.lit(
                    " Transaktion(en) ohne Settlement-Record zählen nur beim Brutto mit; "
                    "Brutto − Fees = Netto gilt in der TOTAL-Zeile hier nicht."
                ),
            ),
        ),
    )


def _summary_rows(kpi: DataFrame, scope: Sequence[str]) -> DataFrame:
    def line(number: int, label: str, value: Column, kind: str, shown: Column | None = None) -> Column:
        entry = F.struct(
            F.lit(number).alias("row_no"), F.lit(label).alias("label"),
            value.cast("string").alias("value"), F.lit(kind).alias("type"),
        )
        return entry if shown is None else F.when(shown, entry)

    some_open = F.col("offen_anzahl_tx") > 0
    lines = F.array(
        line(1, "Anzahl Settlements", F.col("anzahl_settlements"), NUMBER),
        line(2, "Anzahl Transaktionen", F.col("anzahl_tx"), NUMBER),
        line(3, "Brutto Volumen", plain_amount(F.col("brutto")), AMOUNT),
        line(4, "Processing Fees", plain_amount(F.col("fees")), AMOUNT),
        line(5, "Netto Auszahlung", plain_amount(F.col("netto")), AMOUNT),
        line(6, "Ø Netto/Settlement", plain_amount(F.col("avg_netto")), AMOUNT),
        line(7, "Noch nicht abgerechnet (Tx)", F.col("offen_anzahl_tx"), NUMBER, some_open),
        line(8, "Noch nicht abgerechnet (Brutto)", plain_amount(F.col("offen_brutto")), AMOUNT, some_open),
    )
    listed = kpi.select(*scope, F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))
    return _block(
        listed, scope, F.lit(1), F.lit(SUMMARY_BLOCK), F.col("line.row_no"), ROW,
        [F.col("line.label"), F.col("line.value")], F.array(F.lit(TEXT), F.col("line.type")),
    )


def settlement_export_blocks(
    rows: DataFrame,
    end: str | None = None,
    with_detail: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Summary, payment methods, overview and, if wanted, one block per settlement.

    Scopes that the settlement report refuses have no blocks.
    """
    scope = list(scope)
    report = settle.settlement_report(rows, end, with_detail, scope)
    days, methods = report.overview, report.connectors
    kpi = report.kpis.filter(F.size("waehrungen") <= 1)
    amounts = [plain_amount(F.col(c)) for c in ("brutto", "fees", "netto")]
    amount_types = [AMOUNT, AMOUNT, AMOUNT]

    remark = days.groupBy(*scope).agg(
        F.struct(
            F.count_if(F.col("status") == settle.PENDING).alias("n"),
            F.sum(F.when(F.col("status") == settle.PENDING, F.col("anzahl_tx"))).alias("tx"),
            F.sum(F.when(F.col("status") == settle.OPEN, F.col("anzahl_tx"))).alias("open_tx"),
        ).alias("late")
    )
    overview_types = [TEXT, TEXT, NUMBER, *amount_types, TEXT]
    connector_types = [TEXT, NUMBER, *amount_types]
    last = F.lit(2**31)
    volume = Window.partitionBy(*scope).orderBy(*settle.by_volume())
    parts = [
        _block(kpi, scope, F.lit(1), F.lit(SUMMARY_BLOCK), F.lit(0), HEADER,
               [F.lit(c) for c in SUMMARY_HEADER], [TEXT, TEXT]),
        _summary_rows(kpi, scope),
        _block(kpi, scope, F.lit(2), F.lit(CONNECTOR_BLOCK), F.lit(0), HEADER,
               [F.lit(c) for c in CONNECTOR_HEADER], [TEXT] * 5),
        # One row per payment method: the ranking window is as small as that list.
        _block(methods, scope, F.lit(2), F.lit(CONNECTOR_BLOCK), F.row_number().over(volume), ROW,
               [F.col("connector"), F.col("anzahl_tx"), *amounts], connector_types),
        _block(report.connector_total, scope, F.lit(2), F.lit(CONNECTOR_BLOCK), last,
               TOTAL_ROW, [F.lit("TOTAL"), F.col("anzahl_tx"), *amounts], connector_types),
        _block(remark, scope, F.lit(3), F.lit(OVERVIEW_BLOCK), F.lit(0), HEADER,
               [F.lit(c) for c in OVERVIEW_HEADER], [TEXT] * 7, overview_note("late", end)),
        _block(days, scope, F.lit(3), F.lit(OVERVIEW_BLOCK), F.col("nr"), ROW,
               [F.col("nr"), swiss_date(F.col("datum")), F.col("anzahl_tx"), *amounts, F.col("status")],
               overview_types),
        _block(report.totals, scope, F.lit(3), F.lit(OVERVIEW_BLOCK), last, TOTAL_ROW,
               [F.lit("TOTAL"), F.lit(""), F.col("anzahl_tx"), *amounts, F.lit("")], overview_types),
    ]
    if with_detail:
        detail_types = [TEXT, TEXT, TEXT, *amount_types]

        def place(number: str) -> tuple[Column, Column]:
            named = F.coalesce(swiss_date(F.col("datum")), F.col("status"))
            return (
                F.col(number) + FIRST_DETAIL_BLOCK - 1,
                F.concat(F.lit("Settlement "), F.col(number), F.lit(": "), named),
            )

        parts += [
            _block(days, scope, *place("nr"), F.lit(0), HEADER,
                   [F.lit(c) for c in DETAIL_HEADER], [TEXT] * 6),
            _block(report.detail, scope, *place("settlement_nr"), F.col("nr"),
                   ROW, [F.col("nr"), F.col("transaction_id"), F.col("connector"), *amounts], detail_types),
            _block(days, scope, *place("nr"), F.col("anzahl_tx") + 1, TOTAL_ROW,
                   [F.concat(F.lit("Subtotal ("), F.col("anzahl_tx"), F.lit(" Tx)")), F.lit(""), F.lit(""),
                    *amounts], detail_types),
        ]
    stacked = _stack(parts)
    return stacked if scope or report.refused.isEmpty() else stacked.filter(F.lit(False))


def cell_types(blocks: DataFrame) -> DataFrame:
    """One row per cell with its type: the row's own type, which falls back on its column's."""
    return blocks.select(
        "block_no", "block", "row_no",
        F.posexplode(F.arrays_zip("cells", "types")).alias("column_no", "cell"),
    ).select(
        "block_no", "block", "row_no", "column_no",
        F.col("cell.cells").alias("cell"), F.col("cell.types").alias("cell_type"),
    )


def display_cells(blocks: DataFrame) -> DataFrame:
    """Cells as they are shown to people: amounts and counts in Swiss notation, right-aligned."""

    def shown(pair: Column) -> Column:
        cell, kind = pair["cells"], pair["types"]
        return (
            F.when(kind == AMOUNT, swiss_amount(cell.try_cast(TOTAL)))
            .when(kind == NUMBER, swiss_integer(cell.try_cast("bigint")))
            .otherwise(cell)
        )

    return blocks.withColumns(
        {
            "cells": F.transform(F.arrays_zip("cells", "types"), shown),
            "alignment": F.transform(
                "types", lambda kind: F.when(kind == TEXT, "left").otherwise("right")
            ),
        }
    )

"""

Every query runs over the whole derived tables: all spaces, all terminals and a period
that covers all transactions.
"""

from __future__ import annotations

import os
import sys
import uuid
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassenwerk.functions import money, text
from kassenwerk.operators import enrich, history, terminals
from kassenwerk.operators.filters import report_transactions
from kassenwerk.operators.numbering import number_within
from kassenwerk.plans import blocks, checks, reports
from kassenwerk.plans import settlement_model as settle
from kassenwerk.plans import terminal_model as terminal
from kassenwerk.session import scratch_path
from kassenwerk.sources import csv_sink, csv_source, derived_logs, layout, terminal_records
from kassenwerk.sources.derived import SPACES as SPACE_COUNT
from kassenwerk.sources.derived import TERMINALS_PER_SPACE, derived_tables
from kassenwerk.sources.tables import Tables
from kassenwerk.sources.versioned import VersionedTable
from oracle.queries import ORACLE

Query = Callable[[SparkSession, str], DataFrame]

SPACES = list(range(SPACE_COUNT))
TERMINALS = [f"T-{s * 10 + k}" for s in SPACES for k in range(1, TERMINALS_PER_SPACE + 1)]
START, END = "1990-01-01 00:00:00", "2001-08-02 00:00:00"
PERIOD = (SPACES, START, END)
CARD = "77"
ACCOUNT = ["account_id"]
SAMPLE_ROWS = 50  # the samples' and the history's limit is their feature


def _on_tables(run: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(derived_tables(spark, sf_dir))


def _tx(t: Tables) -> DataFrame:
    return report_transactions(t, *PERIOD)


def _terminal_rows(t: Tables) -> DataFrame:
    return reports.terminal_report(t, *PERIOD, TERMINALS, ordered=False)


def _settlement_rows(t: Tables) -> DataFrame:
    return reports.settlement_transactions(t, START, END, with_account=True, ordered=False)


def _sums(t: Tables) -> DataFrame:
    return settle.cube(settle.classified(_settlement_rows(t), END, ACCOUNT), ACCOUNT)


def _overview(t: Tables) -> DataFrame:
    return settle.overview(_sums(t), ACCOUNT)


def _day_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def _saved_outlets(t: Tables) -> DataFrame:
    """Stored outlet names: a merge of two outlets, a blank name and a vanished terminal."""
    return t.paymentterminal.select(
        F.col("identifier").alias("terminal_identifier"),
        F.when(F.col("spaceid") < 2, "Saal").when(F.col("spaceid") == 2, "  ").alias("outlet"),
    )


def _saved_brand_groups(t: Tables) -> DataFrame:
    return t.paymentconnector.select(
        F.col("name")["en-US"].alias("brand"),
        F.when(F.col("id") % 2 == 0, "Mobile").alias("brand_group"),
    ).filter("brand IS NOT NULL")


def _mapped_groups(t: Tables) -> DataFrame:
    rows = _terminal_rows(t)
    return terminal.terminal_group_report(rows, _saved_outlets(t), _saved_brand_groups(t))


def _settlement_detail(t: Tables) -> DataFrame:
    return _day_text(
        settle.settlement_report(_settlement_rows(t), END, scope=ACCOUNT).detail, "datum"
    )


def _kpis(t: Tables) -> DataFrame:
    return settle.kpis(_overview(t), ACCOUNT).withColumn(
        "waehrungen", F.array_join("waehrungen", ",")
    )


def _refusals(t: Tables) -> DataFrame:
    """Every second account has sales in a further currency; the others are reported."""
    foreign = (F.col("account_id") % 2 == 1) & (F.col("transaction_id") % 10 == 0)
    rows = _settlement_rows(t).withColumn("waehrung", F.when(foreign, "USD").otherwise(F.col("waehrung")))
    report = settle.settlement_report(rows, END, with_detail=False, scope=ACCOUNT)
    return report.kpis.join(report.refused.select("account_id", "meldung"), "account_id", "left").select(
        "account_id", "anzahl_settlements", "anzahl_tx", "netto", "offen_brutto",
        F.array_join("waehrungen", ",").alias("waehrungen"), "meldung",
    )


def _as_lines(block_rows: DataFrame, *scope: str) -> DataFrame:
    return block_rows.select(
        *scope,
        "block_no",
        "block",
        "row_no",
        "kind",
        F.array_join("cells", ";").alias("cells"),
        F.array_join("types", ";").alias("types"),
        "note",
    )


def _settlement_blocks(t: Tables) -> DataFrame:
    return blocks.settlement_export_blocks(_settlement_rows(t), END, True, ACCOUNT)


def _terminal_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw result written as CSV, read back by column name, then totalled."""
    path = scratch_path(spark, "terminal-csv")
    csv_sink.write_result_csv(_terminal_rows(derived_tables(spark, sf_dir)), path)
    return terminal.terminal_group_report(csv_source.read_terminal_csv(spark, path).rows)


def _settlement_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "settlement-csv")
    rows = reports.settlement_transactions(derived_tables(spark, sf_dir), START, END, ordered=False)
    csv_sink.write_result_csv(rows, path)
    read = csv_source.read_settlement_csv(spark, path).rows
    scope = ["space_id"]
    sums = settle.cube(settle.classified(read, END, scope), scope)
    return _day_text(settle.overview(sums, scope).drop("waehrungen"), "datum")


def _old_terminal_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter under its other name, in another column order, without the optional columns."""
    path = scratch_path(spark, "old-csv")
    rows = _terminal_rows(derived_tables(spark, sf_dir)).withColumnRenamed("unsettled_anzahl", "unmatched_anzahl")
    columns = ["tip_total", "unmatched_anzahl", "brand", "terminal_name", "brutto_gross", "terminal_identifier"]
    csv_sink.write_result_csv(rows.select(*columns), path)
    return csv_source.read_terminal_csv(spark, path).rows


def _ragged_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one to five cells with commas, quotes and line breaks in them, cut out of split files."""
    path, key, none = scratch_path(spark, "ragged-csv"), F.col("p_partkey"), F.lit("")
    number = key.cast("string")
    remark = F.concat(F.lit('x, "'), "p_type", F.lit('"\n\n'), F.col("p_size").cast("string"))
    cells = (
        F.when(key % 4 == 0, F.array(number, "p_name"))
        .when(key % 4 == 1, F.array(number))
        .when(key % 4 == 2, F.array(number, "p_brand", remark, none))
        .otherwise(F.array(number, none, F.concat("p_name", F.lit("\r\n")), "p_brand", F.lit("ü")))
    )
    quoted = F.transform(
        cells, lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    )
    spark.read.parquet(f"{sf_dir}/part.parquet").select(F.array_join(quoted, ",").alias("value")).write.text(path)
    return csv_source.csv_cells(spark, path).select(
        F.col("cells")[0].cast("bigint").alias("part"), F.size("cells").alias("width"), F.array_join("cells", "|").alias("text")
    )


def _amounts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    written_as = (
        F.when(key % 7 == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .when(key % 7 == 1, F.concat(F.lit("+"), key))
        .when(key % 7 == 2, F.concat(F.lit("-7."), F.lpad(key.cast("string"), 8, "0")))
        .when(key % 7 == 3, F.concat(F.lit("n/a "), key))
        .when(key % 7 == 4, F.lit(""))
        .when(key % 7 == 5, F.concat(F.lit(" "), key, F.lit(".5 ")))
        .otherwise(F.concat(F.lit("."), key % 10))
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), money.read_amount(written_as).alias("amount"))


def _unassigned_spaces(t: Tables) -> DataFrame:
    """Every third space has no account: its sales stay, under no account."""
    t.spacereference = t.spacereference.filter("spaceid % 3 <> 0")
    return _settlement_rows(t).groupBy("account_id").agg(
        F.count("*").alias("anzahl_tx"),
        money.total(F.col("brutto_gross")).alias("brutto"),
        F.count_if(F.col("settlement_state") == "NO_RECORD").alias("offen"),
    )


def _stored_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export over tables stored by month and bucketed by transaction."""
    database = f"stored_{uuid.uuid4().hex}"
    tables = derived_tables(spark, sf_dir)
    stored = layout.write_tables(tables, database, scratch_path(spark, "stored"), layout.buckets_for(tables, 4), layout.MONTH)
    return reports.transaction_export(stored, *PERIOD, columns=reports.EXPORT_COLUMNS.keys())


def _terminal_blocks(t: Tables) -> DataFrame:
    return blocks.terminal_export_blocks(terminal.terminal_group_report(_terminal_rows(t)))


def _displayed(t: Tables) -> DataFrame:
    return blocks.display_cells(_terminal_blocks(t)).select(
        "waehrung", "block_no", "row_no", "kind",
        F.array_join("cells", ";").alias("cells"), F.array_join("alignment", ";").alias("alignment"),
    )


def _nested_terminals(t: Tables) -> DataFrame:
    brand = lambda b: F.concat(
        b["brand"], F.lit(" ("), b["brand_group"], F.lit("): "), b["complete_demand"].cast("string"), F.lit(" / "), b["count"].cast("string")
    )
    return terminal.terminals_with_brands(_terminal_rows(t)).withColumn("brands", F.array_join(F.transform("brands", brand), "; "))


def _terminal_order(t: Tables) -> DataFrame:
    """Every total of the terminal report with its place in it: blocks, currency, then names in German order."""
    rows = terminal.terminal_group_report(_terminal_rows(t), ordered=False).withColumn("_report", F.lit(1))
    order = [terminal.level_order(F.col("level")), "waehrung", *[F.collate(c, "de") for c in ("outlet", "brand_group", "name")], "tid", "brand"]
    return number_within(rows, ["_report"], order, "position").select("level", "waehrung", "outlet", "brand_group", "tid", "brand", "position")


def _connector_order(t: Tables) -> DataFrame:
    """The payment methods of each account by volume, equal ones by name."""
    rows = settle.connectors(_sums(t), ACCOUNT)
    return number_within(rows, ACCOUNT, settle.by_volume(), "position").select("account_id", "connector", "position")


def _amount_texts(t: Tables) -> DataFrame:
    fee = F.col("completedamount") * F.lit("-0.0095").cast("decimal(5,4)")
    return t.transaction.select(
        "id",
        money.swiss_amount(F.col("completedamount")).alias("gross_text"),
        money.swiss_amount(fee).alias("fee_text"),
        money.plain_amount(fee).alias("fee_plain"),
        money.swiss_integer(F.col("id")).alias("id_text"),
    )


def _outlet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = (
        F.when(key % 7 == 0, F.lit("  "))
        .when(key % 5 == 0, key.cast("string"))
        .when(key % 3 == 0, F.concat_ws(" ", F.lit("Bar"), key, F.col("c_mktsegment")))
        .otherwise(F.concat_ws(" ", F.col("c_mktsegment"), key))
    )
    return (
        spark.read.parquet(f"{sf_dir}/customer.parquet")
        .groupBy(text.outlet_group(name).alias("outlet"))
        .agg(F.count("*").alias("terminals"))
    )


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminals.upsert_terminals(
        derived_logs.stored_terminals(spark, sf_dir), derived_logs.delivered_terminals(spark, sf_dir)
    )


def _saved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored list after a delivery that was saved twice."""
    table = VersionedTable(spark, scratch_path(spark, "terminals"), terminals.STORED)
    table.replace(derived_logs.stored_terminals(spark, sf_dir), table.current(), "load")
    for _ in range(2):
        terminals.save_delivery(table, derived_logs.delivered_terminals(spark, sf_dir), "delivery")
    return table.rows()


def _selected_for_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminals.select_for_space(derived_logs.stored_terminals(spark, sf_dir), 8, True)


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.run_log_rows(derived_logs.submissions(spark, sf_dir)).drop("id")


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived_logs.submissions(spark, sf_dir).select("seq", "token", "mode", "submitted_at")
    return history.newest_runs(log, SAMPLE_ROWS)


def _llm() -> tuple[dict[str, Query], dict[str, str]]:
    """The training-data queries and their SQL; none where that subpackage, or what it needs, is not there."""
    try:
        import corpus_pipeline
        from kassenwerk.llm import registry
    except ImportError as missing:
        if missing.name not in ("kassenwerk.llm", "corpus_pipeline"):
            warnings.warn(f"no training-data queries: {missing}", stacklevel=2)
        return {}, {}
    sql = registry.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return registry.queries() | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Query]:
    return _reference_queries() | _llm()[0]


def _reference_queries() -> dict[str, Query]:
    return {
        # Reports
        "brand_report": _on_tables(lambda t: reports.brand_report(t, *PERIOD)),
        "terminal_report": _on_tables(lambda t: reports.terminal_report(t, *PERIOD, TERMINALS)),
        "transaction_export": _on_tables(
            lambda t: reports.transaction_export(t, *PERIOD, columns=reports.EXPORT_COLUMNS.keys())
        ),
        "transaction_export_default": _on_tables(
            lambda t: reports.transaction_export(t, *PERIOD)
        ),
        "transaction_export_terminals": _on_tables(
            lambda t: reports.transaction_export(t, *PERIOD, TERMINALS)
        ),
        "transaction_export_stored": _stored_export,
        "card_search": _on_tables(lambda t: reports.card_search(t, *PERIOD, CARD)),
        "card_search_terminals": _on_tables(
            lambda t: reports.card_search(t, *PERIOD, CARD, TERMINALS)
        ),
        "settlement_transactions": _on_tables(
            lambda t: _day_text(
                reports.settlement_transactions(t, START, END), "settlement_datum"
            )
        ),
        "settlement_reference_sample": _on_tables(
            lambda t: reports.settlement_reference_sample(t, *PERIOD)
        ),
        # Terminal report model
        "terminal_group_report": _on_tables(
            lambda t: terminal.terminal_group_report(_terminal_rows(t))
        ),
        "terminal_group_report_mapped": _on_tables(_mapped_groups),
        "terminal_group_report_nested": _on_tables(_nested_terminals),
        "terminal_report_order": _on_tables(_terminal_order),
        "merged_outlets": _on_tables(
            lambda t: terminal.merged_outlets(_terminal_rows(t), _saved_outlets(t))
        ),
        "merged_brand_groups": _on_tables(
            lambda t: terminal.merged_brand_groups(_terminal_rows(t), _saved_brand_groups(t))
        ),
        "terminal_export_blocks": _on_tables(
            lambda t: _as_lines(
                blocks.terminal_export_blocks(terminal.terminal_group_report(_terminal_rows(t))),
                "waehrung",
            )
        ),
        "terminal_report_lines": _on_tables(
            lambda t: csv_sink.report_lines(
                blocks.terminal_export_blocks(terminal.terminal_group_report(_terminal_rows(t))),
                ["waehrung"],
            )
        ),
        "terminal_csv_roundtrip": _terminal_csv,
        "terminal_csv_defaults": _old_terminal_csv,
        "csv_cells_ragged": _ragged_csv,
        "display_cells": _on_tables(_displayed),
        "cell_types": _on_tables(lambda t: blocks.cell_types(_terminal_blocks(t))),
        # Settlement report model
        "settlement_overview": _on_tables(
            lambda t: _day_text(_overview(t).drop("waehrungen"), "datum")
        ),
        "settlement_kpis": _on_tables(_kpis),
        "settlement_connectors": _on_tables(lambda t: settle.connectors(_sums(t), ACCOUNT)),
        "settlement_connector_order": _on_tables(_connector_order),
        "settlement_connector_total": _on_tables(
            lambda t: settle.totals(settle.connectors(_sums(t), ACCOUNT), ACCOUNT)
        ),
        "settlement_pending": _on_tables(lambda t: settle.pending(_overview(t), ACCOUNT)),
        "settlement_totals": _on_tables(lambda t: settle.totals(_overview(t), ACCOUNT)),
        "settlement_detail": _on_tables(_settlement_detail),
        "settlement_export_blocks": _on_tables(
            lambda t: _as_lines(_settlement_blocks(t), "account_id")
        ),
        "settlement_report_lines": _on_tables(
            lambda t: csv_sink.report_lines(_settlement_blocks(t), ACCOUNT)
        ),
        "settlement_refusals": _on_tables(_refusals),
        "settlement_csv_roundtrip": _settlement_csv,
        "settlement_unassigned_spaces": _on_tables(_unassigned_spaces),
        # Per-transaction sides
        "tip_per_transaction": _on_tables(lambda t: enrich.tips(t, _tx(t), SPACES)),
        "card_per_transaction": _on_tables(lambda t: enrich.cards(t, _tx(t), SPACES)),
        "settlement_per_transaction": _on_tables(lambda t: enrich.settlements(t, _tx(t))),
        "payout_reference": _on_tables(
            lambda t: enrich.payout_references(
                t, _tx(t), enrich.account_withdrawals(t, *PERIOD, enrich.PAYOUT_WINDOW_DAYS)
            )
        ),
        # Verification
        "bank_states": _on_tables(lambda t: checks.bank_states(t, *PERIOD)),
        "fee_sign_check": _on_tables(lambda t: checks.fee_sign_check(t, *PERIOD)),
        "payout_delay_all": _on_tables(lambda t: checks.payout_delay_all(t, *PERIOD)),
        "payout_delay_prefiltered": _on_tables(
            lambda t: checks.payout_delay_prefiltered(t, *PERIOD)
        ),
        "payout_delay_account": _on_tables(lambda t: checks.payout_delay_account(t, *PERIOD)),
        "records_per_transaction": _on_tables(lambda t: checks.records_per_transaction(t, *PERIOD)),
        "settlement_coverage": _on_tables(lambda t: checks.settlement_coverage(t, *PERIOD)),
        "fee_record_matrix": _on_tables(lambda t: checks.fee_record_matrix(t, *PERIOD)),
        "withdrawal_count": _on_tables(lambda t: checks.withdrawal_count(t, START, END)),
        "withdrawal_count_account": _on_tables(
            lambda t: checks.withdrawal_count_account(t, *PERIOD)
        ),
        "settlement_record_count": _on_tables(lambda t: checks.settlement_record_count(t, *PERIOD)),
        "bank_reference_sample": _on_tables(lambda t: checks.bank_reference_sample(t, *PERIOD, SAMPLE_ROWS)),
        "lineitem_types": _on_tables(lambda t: checks.lineitem_types(t, SPACES)),
        "tip_inclusion_check": _on_tables(lambda t: checks.tip_inclusion_check(t, *PERIOD, SAMPLE_ROWS)),
        # Expressions
        "amount_texts": _on_tables(_amount_texts),
        "amount_reader": _amounts_read,
        "outlet_names": _outlet_names,
        # Terminal list and run log
        "terminal_upsert": _upserted,
        "terminal_list_saved": _saved_list,
        "terminal_upsert_counts": lambda s, d: terminals.upsert_counts(_upserted(s, d)),
        "terminal_selection": _selected_for_space,
        "terminal_selection_count": lambda s, d: terminals.changed_count(_selected_for_space(s, d)),
        "terminal_records": lambda s, d: terminal_records.terminal_records(
            derived_logs.terminal_json(s, d)
        ),
        "run_log": _run_log,
        "run_answers": lambda s, d: history.answer_fields(derived_logs.run_answers(s, d)),
        "newest_runs": _newest,
        "newest_runs_of_mode": lambda s, d: history.runs_of_mode(_newest(s, d), "card"),
    }


def entry(spark: SparkSession) -> DataFrame:
    return queries()["brand_report"](spark, "/root/testdata/sf0.001")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE) | _llm()[1]

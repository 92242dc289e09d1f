"""Tables stored by period and transaction: same results, pruned folders, joins without a shuffle."""

import re
import time
import uuid

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from kassenwerk.operators import enrich
from kassenwerk.operators.filters import report_transactions, within
from kassenwerk.plans import checks, reports
from kassenwerk.schema import TABLES
from kassenwerk.session import dropping_shuffles, estimated_bytes, written
from kassenwerk.sources import layout
from kassenwerk.sources.derived import SPACES, derived_tables
from tests.conftest import at, money, plan_of

SF_DIR = "/root/testdata/sf0.001"
PERIOD = (list(range(SPACES)), "1996-02-10 00:00:00", "1996-04-01 00:00:00")
BUCKETS = 5


@pytest.fixture(scope="module")
def tables(spark):
    return derived_tables(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    root, database = str(tmp_path_factory.mktemp("layout")), f"kw_{uuid.uuid4().hex[:8]}"
    layout.write_tables(tables, database, root, BUCKETS, layout.MONTH)
    # As another session would find them: only the folder is known.
    yield layout.open_tables(spark, f"{database}_again", root)
    for name in (database, f"{database}_again"):
        spark.sql(f"DROP DATABASE `{name}` CASCADE")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_stored_tables_hold_all_rows(tables, stored):
    for name in TABLES:
        assert layout.plain(stored[name]).columns == tables[name].columns
        assert stored[name].count() == tables[name].count()


@pytest.mark.parametrize(
    "query",
    [
        lambda t: reports.brand_report(t, *PERIOD),
        lambda t: reports.transaction_export(t, *PERIOD, columns=reports.EXPORT_COLUMNS.keys()),
        lambda t: checks.bank_states(t, *PERIOD),
        lambda t: checks.withdrawal_count(t, *PERIOD[1:]),
    ],
)
def test_reports_over_stored_tables(tables, stored, query):
    assert rows(query(stored)) == rows(query(tables)) != []


def scans(plan):
    """Table -> partition filters of its scans."""
    return {m[1]: m[2] for m in re.finditer(r"FileScan parquet \S+?\.\S+?\.(\w+)\[.*?PartitionFilters: \[(.*?)\], PushedFilters", plan)}


def test_a_period_reads_only_its_folders(spark, stored):
    plan = plan_of(report_transactions(stored, *PERIOD))
    assert "_month" in scans(plan)["transaction"]
    months = report_transactions(stored, *PERIOD).select(F.input_file_name().alias("f")).distinct().collect()
    assert {re.search(r"_month=(\S{10})", r.f)[1] for r in months} == {"1996-02-01", "1996-03-01"}
    narrow = within(stored.currentaccountwithdrawal, "createdon", "1996-02-10", "1996-02-20", 40)
    found = {re.search(r"_month=(\S{10})", r.f)[1] for r in narrow.select(F.input_file_name().alias("f")).distinct().collect()}
    assert found == {"1996-02-01", "1996-03-01"}


def test_joins_on_the_transaction_move_no_rows(stored, no_broadcast):
    tx = report_transactions(stored, *PERIOD)
    for side in (
        enrich.record_counts(stored, tx),
        enrich.has_record(stored, tx),
        enrich.of_report(stored.charge, tx),
        tx.join(enrich.has_record(stored, tx).withColumnRenamed("transaction_id", "id"), "id", "left"),
    ):
        assert "Exchange" not in plan_of(side)


def test_the_export_moves_no_fact_table_by_its_transaction(stored, no_broadcast):
    """What is left is moved by bank transaction, charge and line item, or already summed."""
    plan = plan_of(reports.transaction_export(stored, *PERIOD, columns=reports.EXPORT_COLUMNS.keys(), ordered=False))
    moved = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#\d+L?(?:, [a-z_]+#\d+L?)*, (\d+)\)", plan)
    assert "_month" in scans(plan)["transaction"]
    assert {"banktransaction_id"} <= {name for name, _ in moved}
    for line in plan.splitlines():
        if "FileScan" in line and re.search(r"\.(transaction|charge|payfacsettlementrecord|transaction_lineitem)\[", line):
            assert "Bucketed: true" in line and f"{BUCKETS} out of {BUCKETS}" in line


def test_buckets_grow_with_the_rows(tables, monkeypatch):
    """The largest table decides; a few rows still get the least number."""
    most = max(tables[n].count() for n, how in layout.STORED.items() if how.bucket)
    assert layout.buckets_for(tables, 4) == 4
    monkeypatch.setattr(layout, "ROWS_PER_BUCKET", most // 10)
    assert 10 <= layout.buckets_for(tables, 4) <= 11
    monkeypatch.setattr(layout, "ROWS_PER_BUCKET", most // 20)
    assert 20 <= layout.buckets_for(tables, 4) <= 21


def test_the_stored_export_takes_its_buckets_from_the_rows(spark, tables, monkeypatch):
    most = max(tables[n].count() for n, how in layout.STORED.items() if how.bucket)
    monkeypatch.setattr(layout, "ROWS_PER_BUCKET", most // 6)
    asked, write = [], layout.write_tables
    monkeypatch.setattr(layout, "write_tables", lambda t, d, root, buckets, period: asked.append(buckets) or write(t, d, root, buckets, period))
    plain = reports.transaction_export(tables, *registered.PERIOD, columns=reports.EXPORT_COLUMNS.keys())
    assert rows(registered.queries()["transaction_export_stored"](spark, SF_DIR)) == rows(plain) != []
    assert 6 <= asked[0] <= 7


# --- Disk --------------------------------------------------------------------


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString("\n").split("\n") if "shuffle_" in name}


def left_behind(spark, before):
    """New shuffle files; they are removed in the background."""
    for _ in range(50):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


@pytest.fixture
def small_tables(make_tables):
    """Three sales with a tip, card, record and payout each, ids of texts as long as real ones."""
    nos = range(1, 4)
    return make_tables(
        transaction=[
            {"id": i, "spaceid": 1, "completedon": at(f"1996-02-1{i} 10:00:00"), "state": "FULFILL", "currency": "CHF",
             "completedamount": money("9.5"), "paymentconnectorconfiguration_id": 4}
            for i in nos
        ],
        charge=[{"id": 10 + i, "transaction_id": i} for i in nos],
        chargeattempt=[{"id": 20 + i, "charge_id": 10 + i, "spaceid": 1, "labels": []} for i in nos],
        payfacsettlementrecord=[{"transaction_id": i, "banktransaction_id": f"bank-{i}"} for i in nos],
        banktransaction=[{"id": f"bank-{i}", "state": "SETTLED", "valuedate": at("1996-02-20 00:00:00")} for i in nos],
        spacereference=[{"spaceid": 1, "accountid": 5}],
        currentaccountwithdrawal=[{"internalreference": "W", "createdon": at("1996-02-21 00:00:00"), "accountid": 5}],
        transaction_lineitem=[{"transaction_id": i, "lineitems_id": f"item-{i}", "spaceid": 1} for i in nos],
        lineitem=[{"id": f"item-{i}", "spaceid": 1, "type": "TIP", "amountincludingtax": money("0.5")} for i in nos],
    )


@pytest.fixture
def small_stored(spark, small_tables, tmp_path):
    database = f"kw_{uuid.uuid4().hex[:8]}"
    yield layout.write_tables(small_tables, database, str(tmp_path), 2, layout.MONTH)
    spark.sql(f"DROP DATABASE `{database}` CASCADE")


def test_storing_leaves_no_shuffle_and_packs_the_ids(spark, small_tables, tmp_path):
    before, database = shuffle_files(spark), f"kw_{uuid.uuid4().hex[:8]}"
    layout.write_tables(small_tables, database, str(tmp_path), 2, layout.MONTH)
    assert not left_behind(spark, before)
    for name in ("banktransaction", "lineitem"):
        files = ds.dataset(f"{tmp_path}/{name}", format="parquet").get_fragments()
        ids = [f.metadata.row_group(0).column(0) for f in files if f.metadata.num_row_groups]
        assert ids and all(c.compression == "ZSTD" and "DELTA_BYTE_ARRAY" in c.encodings for c in ids)
    spark.sql(f"DROP DATABASE `{database}` CASCADE")


def test_the_largest_table_is_stored_first(tables):
    sizes = [estimated_bytes(tables[name]) for name in layout._largest_first(tables)]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == len(TABLES)


def test_an_ordered_export_of_stored_tables_leaves_its_sort_only(spark, small_tables, small_stored, no_broadcast):
    """The sides and their joins are over and their shuffles gone when the sort begins."""
    before, columns = shuffle_files(spark), reports.EXPORT_COLUMNS.keys()
    df = reports.transaction_export(small_stored, *PERIOD, columns=columns)
    assert not left_behind(spark, before)
    assert re.findall(r"Exchange (\w+)", plan_of(df)) == ["rangepartitioning"]
    found, plain = df.collect(), reports.transaction_export(small_tables, *PERIOD, columns=columns).collect()
    assert found == plain and [r.settlement_reference for r in found] == ["W"] * 3
    assert [str(r.tip_amount) for r in found] == ["0.50000000"] * 3


def test_settings_outlive_a_write(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), dropping_shuffles(spark):
        assert spark.conf.get(name) == "true"
        1 / 0
    assert spark.conf.get(name) == before


def test_what_is_written_keeps_its_rows_and_no_shuffle(spark):
    before, df = shuffle_files(spark), spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = written(df, "counts")
    assert not left_behind(spark, before)
    assert rows(kept) == rows(df) and rows(df) == rows(df)


def test_unknown_periods_are_refused(tables, tmp_path):
    with pytest.raises(ValueError, match="period"):
        layout.write_tables(tables, "kw_never", str(tmp_path), 2, "_week")

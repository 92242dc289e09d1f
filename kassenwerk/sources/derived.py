"""The payment tables derived from the star-schema test tables.

Every table is a plain projection (plus an explode where one row yields several), so a
query over them shuffles only for its own joins and aggregates, and filters and column
pruning reach the parquet scans. Space 0 deliberately holds about a third of the
transactions. ``oracle/derived.py`` states the same tables in another SQL dialect.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from kassenwerk.functions.labels import AUTH_CODE_LABEL, MASKED_CARD_LABEL
from kassenwerk.sources.tables import Tables

SPACES = 25
ACCOUNTS = 5
CONNECTORS = 25
TERMINALS_PER_SPACE = 3


def _money(cents_as_double: str) -> str:
    return f"CAST(CAST({cents_as_double} AS DECIMAL(18,2)) AS DECIMAL(20,8))"


def _fee(amount: str) -> str:
    return f"CAST(round({amount} * 0.0095BD, 2) AS DECIMAL(20,8))"


def _space(order_key: str) -> str:
    return f"CASE WHEN {order_key} % 10 < 3 THEN 0L ELSE {order_key} % {SPACES} END"


def _label(descriptor: str, text: str) -> str:
    return f"map('descriptor', '{descriptor}', 'shortTextContent', {text})"


_GROSS = _money("o_totalprice")
_POSTING = _money("l_extendedprice")
_ORDER_SPACE, _LINE_SPACE = _space("o_orderkey"), _space("l_orderkey")
_LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " unix_date(CAST(l_shipdate AS DATE)), CAST(round(l_extendedprice * 100) AS BIGINT))"
)
# Every fourth order has not been settled at all.
_HAS_RECORDS = "l_orderkey % 4 <> 0"
_CARD = "concat('XXXX-XXXX-XXXX-', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'))"

# Table -> the test table it comes from, row filter, steps of projections.
_DERIVED: dict[str, tuple[str, str | None, list[list[str]]]] = {
    "transaction": ("orders", None, [[
        "o_orderkey AS id",
        f"{_ORDER_SPACE} AS spaceid",
        "o_orderdate - make_dt_interval(0, 0, 0, o_orderkey % 86400) AS createdon",
        "o_orderdate AS completedon",
        "CASE o_orderstatus WHEN 'F' THEN 'FULFILL' WHEN 'O' THEN 'COMPLETED' ELSE 'PENDING' END AS state",
        f"CASE WHEN ({_ORDER_SPACE}) % {ACCOUNTS} = 0 THEN 'EUR' ELSE 'CHF' END AS currency",
        f"{_GROSS} AS completedamount",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DECIMAL(20,8))"
        f" ELSE {_fee(_GROSS)} END AS totalappliedfees",
        f"o_custkey % {CONNECTORS} AS paymentconnectorconfiguration_id",
        f"CASE WHEN o_orderkey % 5 <> 0 THEN ({_ORDER_SPACE}) * 10 + o_orderkey % {TERMINALS_PER_SPACE} + 1 END"
        " AS terminal_id",
        "concat('M-', o_orderkey) AS merchantreference",
    ]]),
    "spacereference": ("nation", None, [[
        "CAST(n_nationkey AS BIGINT) AS spaceid", "CAST(n_regionkey AS BIGINT) AS accountid",
    ]]),
    "paymentconnectorconfiguration": ("nation", None, [
        ["CAST(n_nationkey AS BIGINT) AS spaceid", f"explode(sequence(0L, {CONNECTORS - 1}L)) AS id"],
        ["id", "spaceid", f"(id + spaceid) % {CONNECTORS} AS connector"],
        ["id", "spaceid", "connector",
         "CASE WHEN connector % 10 <> 0 THEN concat_ws(' ', 'Config', id, spaceid) END AS name"],
    ]),
    "paymentconnector": ("nation", None, [
        ["CAST(n_nationkey AS BIGINT) AS id"],
        ["id",
         "CASE WHEN id % 5 = 0 THEN map('de-DE', concat('Marke ', id + 1))"
         " ELSE map('en-US', CASE WHEN id = 7 THEN 'Lunch Check' ELSE concat('Brand#', id + 1) END) END AS name"],
    ]),
    "paymentterminal": ("nation", None, [
        ["CAST(n_nationkey AS BIGINT) AS spaceid", f"explode(sequence(1, {TERMINALS_PER_SPACE})) AS k"],
        ["spaceid * 10 + k AS id", "spaceid", "concat('T-', spaceid * 10 + k) AS identifier",
         "concat_ws(' ', 'Outlet', char(spaceid + 65), k) AS name"],
    ]),
    "charge": ("orders", None, [["o_orderkey AS id", "o_orderkey AS transaction_id"]]),
    "chargeattempt": ("orders", None, [
        ["o_orderkey", "o_custkey", "explode(sequence(0L, o_orderkey % 2)) AS attempt"],
        ["o_orderkey", "o_custkey", "o_orderkey * 2 + attempt AS id"],
        ["id", "o_orderkey AS charge_id", f"{_ORDER_SPACE} AS spaceid",
         "CASE WHEN id % 7 = 0 THEN CAST(array() AS ARRAY<MAP<STRING, STRING>>)"
         f" ELSE array({_label(MASKED_CARD_LABEL, _CARD)}, {_label(AUTH_CODE_LABEL, "concat('A', id)")})"
         " END AS labels"],
    ]),
    "payfacsettlementrecord": ("lineitem", _HAS_RECORDS, [[
        "l_orderkey AS transaction_id", f"{_LINE_ID} AS banktransaction_id",
    ]]),
    "banktransaction": ("lineitem", _HAS_RECORDS, [[
        f"{_LINE_ID} AS id",
        "CASE WHEN l_linestatus = 'F' THEN 'SETTLED' ELSE 'UPCOMING' END AS state",
        "CASE WHEN l_linestatus = 'F' OR l_returnflag <> 'N'"
        " THEN l_shipdate + make_dt_interval(0, l_linenumber * 2) END AS valuedate",
        f"{_POSTING} AS postingamount",
        f"CAST({_POSTING} - {_fee(_POSTING)} AS DECIMAL(20,8)) AS valueamount",
        "concat('B-', l_suppkey) AS reference",
        "l_shipdate AS paymentdate",
    ]]),
    "currentaccountwithdrawal": ("orders", "unix_date(CAST(o_orderdate AS DATE)) % 2 = 0", [
        ["o_orderdate AS day"],
        ["day", f"explode(sequence(0L, {ACCOUNTS - 1}L)) AS accountid"],
        ["concat_ws('-', 'W', accountid, CAST(CAST(day AS DATE) AS STRING)) AS internalreference",
         "day + make_dt_interval(0, CAST(accountid * 3 AS INT)) AS createdon", "accountid"],
    ]),
    "transaction_lineitem": ("lineitem", None, [[
        "l_orderkey AS transaction_id", f"{_LINE_ID} AS lineitems_id", f"{_LINE_SPACE} AS spaceid",
    ]]),
    "lineitem": ("lineitem", None, [[
        f"{_LINE_ID} AS id",
        f"{_LINE_SPACE} AS spaceid",
        "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'TIP' ELSE 'PRODUCT' END AS type",
        f"{_POSTING} AS amountincludingtax",
    ]]),
}


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    @cache
    def read(source: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{source}.parquet")

    def derive(name: str) -> DataFrame:
        source, kept, steps = _DERIVED[name]
        df = read(source) if kept is None else read(source).filter(kept)
        first, *rest = steps
        df = df.selectExpr(*first)
        if name == "currentaccountwithdrawal":
            # Withdrawals happen once per day and account, however many orders the day has.
            df = df.distinct()
        for projection in rest:
            df = df.selectExpr(*projection)
        return df

    return Tables({name: lambda name=name: derive(name) for name in _DERIVED})

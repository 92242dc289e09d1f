"""The payment tables of ``kassenwerk.sources.derived`` as SQL common table expressions."""

SPACE = "CASE WHEN {key} % 10 < 3 THEN 0 ELSE {key} % 25 END"
MONEY = "CAST(CAST({x} AS DECIMAL(18,2)) AS DECIMAL(20,8))"
LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), CAST(round(l_extendedprice * 100) AS BIGINT))"
)
POSTING = MONEY.format(x="l_extendedprice")
GROSS = MONEY.format(x="o_totalprice")

TABLES = {
    "sr": "SELECT CAST(n_nationkey AS BIGINT) AS spaceid, CAST(n_regionkey AS BIGINT) AS accountid FROM nation",
    "t": f"""
SELECT o_orderkey AS id, {SPACE.format(key="o_orderkey")} AS spaceid,
       o_orderdate - to_seconds(o_orderkey % 86400) AS createdon, o_orderdate AS completedon,
       CASE o_orderstatus WHEN 'F' THEN 'FULFILL' WHEN 'O' THEN 'COMPLETED' ELSE 'PENDING' END AS state,
       CASE WHEN ({SPACE.format(key="o_orderkey")}) % 5 = 0 THEN 'EUR' ELSE 'CHF' END AS currency,
       {GROSS} AS completedamount,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DECIMAL(20,8))
            ELSE CAST(round({GROSS} * 0.0095, 2) AS DECIMAL(20,8)) END AS totalappliedfees,
       o_custkey % 25 AS cfg_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            ELSE ({SPACE.format(key="o_orderkey")}) * 10 + o_orderkey % 3 + 1 END AS terminal_id,
       'M-' || o_orderkey AS merchantreference
FROM orders""",
    "pcc": """
SELECT k.id, s.spaceid, (k.id + s.spaceid) % 25 AS connector,
       CASE WHEN (k.id + s.spaceid) % 25 % 10 <> 0 THEN concat_ws(' ', 'Config', k.id, s.spaceid) END AS name
FROM sr s, range(0, 25) k(id)""",
    "pc": """
SELECT spaceid AS id,
       CASE WHEN spaceid % 5 <> 0
            THEN CASE WHEN spaceid = 7 THEN 'Lunch Check' ELSE 'Brand#' || (spaceid + 1) END END AS name_en
FROM sr""",
    "pt": """
SELECT s.spaceid * 10 + k.k AS id, s.spaceid, 'T-' || (s.spaceid * 10 + k.k) AS identifier,
       concat_ws(' ', 'Outlet', chr(CAST(s.spaceid + 65 AS INTEGER)), k.k) AS name
FROM sr s, range(1, 4) k(k)""",
    "ca": """
SELECT a.id, a.o_orderkey AS transaction_id, a.spaceid,
       CASE WHEN a.id % 7 <> 0 THEN 'XXXX-XXXX-XXXX-' || lpad(CAST(a.o_custkey % 10000 AS VARCHAR), 4, '0') END AS masked_card,
       CASE WHEN a.id % 7 <> 0 THEN 'A' || a.id END AS auth_code
FROM (SELECT o_orderkey, o_custkey, """ + SPACE.format(key="o_orderkey") + """ AS spaceid,
             o_orderkey * 2 + unnest(range(0, o_orderkey % 2 + 1)) AS id FROM orders) a""",
    "psr": f"SELECT l_orderkey AS transaction_id, {LINE_ID} AS banktransaction_id FROM lineitem WHERE l_orderkey % 4 <> 0",
    "bt": f"""
SELECT {LINE_ID} AS id, CASE WHEN l_linestatus = 'F' THEN 'SETTLED' ELSE 'UPCOMING' END AS state,
       CASE WHEN l_linestatus = 'F' OR l_returnflag <> 'N' THEN l_shipdate + to_hours(l_linenumber * 2) END AS valuedate,
       {POSTING} AS postingamount,
       CAST({POSTING} - CAST(round({POSTING} * 0.0095, 2) AS DECIMAL(20,8)) AS DECIMAL(20,8)) AS valueamount,
       'B-' || l_suppkey AS reference, l_shipdate AS paymentdate
FROM lineitem WHERE l_orderkey % 4 <> 0""",
    "w": """
SELECT 'W-' || a.accountid || '-' || strftime(d.day, '%Y-%m-%d') AS internalreference,
       d.day + to_hours(CAST(a.accountid * 3 AS INTEGER)) AS createdon, a.accountid
FROM (SELECT DISTINCT o_orderdate AS day FROM orders
      WHERE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) % 2 = 0) d,
     range(0, 5) a(accountid)""",
    "tl": f"SELECT l_orderkey AS transaction_id, {LINE_ID} AS lineitems_id, {SPACE.format(key='l_orderkey')} AS spaceid FROM lineitem",
    "li": f"""
SELECT {LINE_ID} AS id, {SPACE.format(key='l_orderkey')} AS spaceid,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'TIP' ELSE 'PRODUCT' END AS type,
       {POSTING} AS amountincludingtax
FROM lineitem""",
}


def with_tables(body: str, **more: str) -> str:
    """``body`` with the payment tables, and then ``more``, as common table expressions."""
    named = {**TABLES, **more}
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in named.items()) + "\n" + body

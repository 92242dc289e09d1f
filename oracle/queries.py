"""One SQL statement per registered query, over the raw star-schema tables."""

from __future__ import annotations

from oracle.derived import with_tables

START, END = "TIMESTAMP '1990-01-01'", "TIMESTAMP '2001-08-02'"
END_DAY = "DATE '2001-08-01'"

TX = f"""
SELECT * FROM t WHERE completedon >= {START} AND completedon < {END}
   AND state IN ('FULFILL', 'COMPLETED') AND spaceid BETWEEN 0 AND 24"""

TIP = """
SELECT tl.transaction_id, sum(li.amountincludingtax) AS tip_amount
FROM tl JOIN li ON li.id = tl.lineitems_id AND li.spaceid = tl.spaceid
WHERE li.type = 'TIP' AND tl.transaction_id IN (SELECT id FROM tx) GROUP BY 1"""

CARD = """
SELECT transaction_id, arg_max_null(masked_card, id) AS masked_card, arg_max_null(auth_code, id) AS auth_code
FROM ca WHERE transaction_id IN (SELECT id FROM tx) GROUP BY 1"""

BANK = """
SELECT psr.transaction_id, psr.banktransaction_id, bt.* FROM psr JOIN bt ON bt.id = psr.banktransaction_id
WHERE psr.transaction_id IN (SELECT id FROM tx)"""

SETTLE = """
SELECT transaction_id,
       CASE WHEN bool_and(state = 'SETTLED') THEN 'SETTLED' WHEN bool_or(state = 'SETTLED') THEN 'PARTIAL'
            ELSE 'UPCOMING' END AS settlement_state,
       max(valuedate) AS valuedate, sum(postingamount) AS settlement_gross,
       sum(postingamount - valueamount) AS processing_fees, sum(valueamount) AS netamount,
       count(*) AS settlement_records
FROM bank GROUP BY 1"""

# Nearest following withdrawal by an as-of join per bank row, then the earliest per transaction.
PAYOUT = f"""
SELECT transaction_id, arg_min(internalreference, createdon) AS settlement_reference
FROM (SELECT b.transaction_id, b.valuedate, x.internalreference, x.createdon
      FROM (SELECT bank.*, sr.accountid FROM bank JOIN tx ON tx.id = bank.transaction_id
            JOIN sr ON sr.spaceid = tx.spaceid WHERE bank.state = 'SETTLED') b
      ASOF JOIN (SELECT * FROM w WHERE createdon >= {START} AND createdon < {END} + INTERVAL 10 DAY) x
      ON x.accountid = b.accountid AND x.createdon >= b.valuedate)
WHERE createdon < valuedate + INTERVAL 10 DAY GROUP BY 1"""

BRANDED = """
SELECT tx.*, coalesce(pc.name_en, pcc.name, 'UNKNOWN') AS brand, pcc.connector,
       pt.identifier AS terminal_identifier, pt.name AS terminal_name
FROM tx LEFT JOIN pcc ON pcc.id = tx.cfg_id AND pcc.spaceid = tx.spaceid
        LEFT JOIN pc ON pc.id = pcc.connector
        LEFT JOIN pt ON pt.id = tx.terminal_id AND pt.spaceid = tx.spaceid"""

SIDES = dict(tx=TX, tip=TIP, card=CARD, bank=BANK, settle=SETTLE, payout=PAYOUT, branded=BRANDED)

_MEASURES = """
count(*) AS anzahl_transaktionen,
count(*) FILTER (WHERE coalesce(totalappliedfees, 0) = 0 AND id NOT IN (SELECT transaction_id FROM psr)) AS unsettled_anzahl,
sum(completedamount) AS brutto_gross, sum(totalappliedfees) AS transaction_fee_total,
sum(completedamount) - coalesce(sum(totalappliedfees), 0) AS netto, coalesce(sum(tip_amount), 0) AS tip_total"""

TERMINAL_ROWS = f"""
SELECT spaceid AS space_id, terminal_identifier, terminal_name, brand, currency AS waehrung, {_MEASURES}
FROM branded LEFT JOIN tip ON tip.transaction_id = branded.id WHERE terminal_identifier IS NOT NULL
GROUP BY 1, 2, 3, 4, 5"""

SETTLEMENT_ROWS = """
SELECT sr.accountid AS account_id, CAST(s.valuedate AS DATE) AS settlement_datum,
       coalesce(s.settlement_state, 'NO_RECORD') AS settlement_state, b.id AS transaction_id,
       b.merchantreference AS merchant_reference, b.spaceid AS space_id, b.currency AS waehrung,
       b.brand AS connector,
       CASE WHEN b.terminal_id IS NULL THEN 'Ecommerce' ELSE 'Physical Terminal' END AS sales_channel,
       b.terminal_identifier, b.completedamount AS brutto_gross, s.settlement_gross,
       s.processing_fees, s.netamount, coalesce(s.settlement_records, 0) AS settlement_records
FROM branded b JOIN sr ON sr.spaceid = b.spaceid LEFT JOIN settle s ON s.transaction_id = b.id"""

CLASSIFIED = f"""
SELECT account_id, space_id, transaction_id, connector, waehrung,
       CASE WHEN settlement_datum IS NULL THEN 'Offen' WHEN settlement_datum > {END_DAY} THEN 'Ausstehend'
            ELSE 'Settled' END AS status, settlement_datum AS datum,
       CASE WHEN settlement_state = 'NO_RECORD' THEN brutto_gross ELSE settlement_gross END AS brutto,
       coalesce(processing_fees, 0) AS fees, coalesce(netamount, 0) AS netto
FROM settlement_rows"""


def _overview(scope: str) -> str:
    return f"""
SELECT {scope}, row_number() OVER (PARTITION BY {scope} ORDER BY status = 'Offen', datum) AS nr,
       datum, status, count(*) AS anzahl_tx, sum(brutto) AS brutto, sum(fees) AS fees, sum(netto) AS netto
FROM classified GROUP BY {scope}, datum, status"""


_TENTH = "CAST(0.00000001 AS DECIMAL(8,8))"
KPI = f"""
SELECT account_id, count(*) FILTER (WHERE status <> 'Offen') AS anzahl_settlements,
       CAST(coalesce(sum(anzahl_tx) FILTER (WHERE status <> 'Offen'), 0) AS BIGINT) AS anzahl_tx,
       coalesce(sum(brutto) FILTER (WHERE status <> 'Offen'), 0) AS brutto,
       coalesce(sum(fees) FILTER (WHERE status <> 'Offen'), 0) AS fees,
       coalesce(sum(netto) FILTER (WHERE status <> 'Offen'), 0) AS netto,
       CAST(coalesce(sum(anzahl_tx) FILTER (WHERE status = 'Offen'), 0) AS BIGINT) AS offen_anzahl_tx,
       coalesce(sum(brutto) FILTER (WHERE status = 'Offen'), 0) AS offen_brutto
FROM overview GROUP BY 1"""
# DuckDB divides decimals as floating point; the average is taken in whole 1e-8 units.
AVERAGE = f"""
SELECT *, CAST((CAST(netto * 100000000 AS HUGEINT) * 2 + anzahl_settlements) // (2 * anzahl_settlements) AS DECIMAL(30,0))
       * {_TENTH} AS avg_netto FROM kpi"""
CONNECTORS = """
SELECT account_id, connector, count(*) AS anzahl_tx, sum(brutto) AS brutto, sum(fees) AS fees, sum(netto) AS netto
FROM classified WHERE status <> 'Offen' GROUP BY 1, 2"""

MODEL = dict(
    SIDES, settlement_rows=SETTLEMENT_ROWS, classified=CLASSIFIED, overview=_overview("account_id"),
    kpi=KPI, averaged=AVERAGE, connectors=CONNECTORS,
)


def _groups(outlet: str, brand_group: str) -> str:
    return f"""
SELECT CASE WHEN grouping(tid) = 0 THEN 'detail' WHEN grouping(outlet) = 0 THEN 'outlet'
            WHEN grouping(brand_group) = 0 THEN 'brand_group' ELSE 'grand_total' END AS level,
       waehrung, outlet, brand_group, tid, name, brand, sum(brutto_gross) AS complete_demand,
       sum(tip_total) AS tip, CAST(sum(unsettled_anzahl) AS BIGINT) AS unmatched,
       CAST(sum(anzahl_transaktionen) AS BIGINT) AS count
FROM (SELECT *, {outlet} AS outlet, {brand_group} AS brand_group, terminal_identifier AS tid,
             terminal_name AS name FROM terminal_rows)
GROUP BY GROUPING SETS ((waehrung, outlet, brand_group, tid, name, brand),
                        (waehrung, outlet, brand_group), (waehrung, brand_group), (waehrung))"""


AUTO_OUTLET = r"regexp_replace(terminal_name, '\s*[0-9]+$', '')"
AUTO_GROUP = "CASE WHEN brand = 'Lunch Check' THEN 'Lunch-Check' ELSE 'Default' END"
SAVED_OUTLET = f"CASE WHEN space_id < 2 THEN 'Saal' ELSE {AUTO_OUTLET} END"
SAVED_GROUP = f"CASE WHEN brand IN (SELECT name_en FROM pc WHERE id % 2 = 0) THEN 'Mobile' ELSE {AUTO_GROUP} END"
GROUPS = dict(SIDES, terminal_rows=TERMINAL_ROWS, groups=_groups(AUTO_OUTLET, AUTO_GROUP))


def _plain(amount: str) -> str:
    return rf"regexp_replace(CAST(CAST(round({amount}, 2) AS DECIMAL(38,2)) AS VARCHAR), '\.?0+$', '')"


_GROUP_NUMBERS = f"{_plain('complete_demand')}, {_plain('tip')}, unmatched, count"
_NUMBER_TYPES = "betrag;betrag;zahl;zahl"
_MEASURE_HEADS = "Complete Demand;Tip;Unmatched;Anz."
TERMINAL_BLOCKS = f"""
SELECT waehrung, CAST(block_no AS BIGINT) AS block_no, block, 1 AS row_no, kind,
       concat_ws(';', lead_cells, {_GROUP_NUMBERS}) AS cells, types, '' AS note
FROM (SELECT *, CASE level WHEN 'outlet' THEN 1 WHEN 'brand_group' THEN 2 WHEN 'grand_total' THEN 3 ELSE 4 END AS block_no,
             CASE level WHEN 'outlet' THEN 'Total Outlet-Gruppen' WHEN 'brand_group' THEN 'Total Brand-Gruppen'
                        WHEN 'grand_total' THEN 'Gesamttotal' ELSE 'Detail' END AS block,
             CASE level WHEN 'grand_total' THEN 'total' ELSE 'row' END AS kind,
             CASE level WHEN 'outlet' THEN outlet || ';' || brand_group WHEN 'brand_group' THEN brand_group
                        WHEN 'grand_total' THEN 'Total'
                        ELSE outlet || ';' || tid || ';' || name || ';' || brand || ';' || brand_group END AS lead_cells,
             CASE level WHEN 'outlet' THEN 'text;text;' WHEN 'brand_group' THEN 'text;' WHEN 'grand_total' THEN 'text;'
                        ELSE 'text;text;text;text;text;' END || '{_NUMBER_TYPES}' AS types
      FROM groups)
UNION ALL
SELECT c.waehrung, h.* FROM (SELECT DISTINCT waehrung FROM groups) c, (VALUES
  (1, 'Total Outlet-Gruppen', 0, 'header', 'Outlet-Gruppe;Brand-Gruppe;{_MEASURE_HEADS}', 'text;text;text;text;text;text', ''),
  (2, 'Total Brand-Gruppen', 0, 'header', 'Brand-Gruppe;{_MEASURE_HEADS}', 'text;text;text;text;text', ''),
  (3, 'Gesamttotal', 0, 'header', ';{_MEASURE_HEADS}', 'text;text;text;text;text', ''),
  (4, 'Detail', 0, 'header', 'Outlet-Gruppe;TID;Terminal;Brand;Brand-Gruppe;{_MEASURE_HEADS}',
   'text;text;text;text;text;text;text;text;text', '')) h"""
TERMINAL_LINES = """
SELECT waehrung, block_no, row_no, 0 AS line_no, cells AS line FROM terminal_blocks WHERE row_no = 1
UNION ALL
SELECT waehrung, block_no, row_no, unnest(range(0, len(lines))) AS line_no, unnest(lines) AS line
FROM (SELECT *, CASE WHEN block_no = 1 THEN [chr(65279) || block, cells] ELSE ['', block, cells] END AS lines
      FROM terminal_blocks WHERE row_no = 0)"""

_AMOUNTS = f"{_plain('brutto')}, {_plain('fees')}, {_plain('netto')}"
_B3 = "betrag;betrag;betrag"
_LAST = 2**31
_NAMED = "'Settlement ' || nr || ': ' || coalesce(strftime(datum, '%d.%m.%Y'), status)"
_SUMMARY = ",\n".join(
    f"({number}, '{label}', {value}, '{kind}', {shown})"
    for number, label, value, kind, shown in [
        (1, "Anzahl Settlements", "CAST(anzahl_settlements AS VARCHAR)", "zahl", "true"),
        (2, "Anzahl Transaktionen", "CAST(anzahl_tx AS VARCHAR)", "zahl", "true"),
        (3, "Brutto Volumen", _plain("brutto"), "betrag", "true"),
        (4, "Processing Fees", _plain("fees"), "betrag", "true"),
        (5, "Netto Auszahlung", _plain("netto"), "betrag", "true"),
        (6, "Ø Netto/Settlement", _plain("avg_netto"), "betrag", "true"),
        (7, "Noch nicht abgerechnet (Tx)", "CAST(offen_anzahl_tx AS VARCHAR)", "zahl", "offen_anzahl_tx > 0"),
        (8, "Noch nicht abgerechnet (Brutto)", _plain("offen_brutto"), "betrag", "offen_anzahl_tx > 0"),
    ]
)
# Block titles, headers and sentences of the export.
SETTLEMENT_BLOCKS = f"""
SELECT account_id, 1 AS block_no, 'Zusammenfassung' AS block, 0 AS row_no, 'header' AS kind, 'Kennzahl;Wert' AS cells,
       'text;text' AS types, '' AS note FROM averaged
UNION ALL
SELECT account_id, 1, 'Zusammenfassung', x.n, 'row', x.label || ';' || x.value, 'text;' || x.type, ''
FROM averaged, LATERAL (SELECT * FROM (VALUES {_SUMMARY}) v(n, label, value, type, shown)) x WHERE x.shown
UNION ALL
SELECT account_id, 2, 'Aufschlüsselung nach Zahlungsmittel', 0, 'header', 'Zahlungsmittel;Tx;Brutto;Fees;Netto',
       'text;text;text;text;text', '' FROM averaged
UNION ALL
SELECT account_id, 2, 'Aufschlüsselung nach Zahlungsmittel',
       row_number() OVER (PARTITION BY account_id ORDER BY brutto DESC, connector), 'row',
       concat_ws(';', connector, anzahl_tx, {_AMOUNTS}), 'text;zahl;{_B3}', '' FROM connectors
UNION ALL
SELECT account_id, 2, 'Aufschlüsselung nach Zahlungsmittel', {_LAST}, 'total',
       concat_ws(';', 'TOTAL', anzahl_tx, {_AMOUNTS}), 'text;zahl;{_B3}', ''
FROM (SELECT account_id, sum(anzahl_tx) AS anzahl_tx, sum(brutto) AS brutto, sum(fees) AS fees, sum(netto) AS netto
      FROM connectors GROUP BY 1)
UNION ALL
SELECT account_id, 3, 'Settlement-Übersicht', 0, 'header', '#;Settlement Datum;Tx;Brutto;Fees;Netto;Status',
       'text;text;text;text;text;text;text', concat_ws(' ',
       CASE WHEN n > 0 THEN n || ' Settlement(s) mit ' || tx || ' Transaktionen werden erst nach dem '
            || strftime({END_DAY}, '%d.%m.%Y') || ' abgerechnet.' END,
       CASE WHEN open_tx > 0 THEN open_tx || ' Transaktion(en) ohne Settlement-Record zählen nur beim Brutto mit; '
            || 'Brutto − Fees = Netto gilt in der TOTAL-Zeile hier nicht.' END)
FROM (SELECT account_id, count(*) FILTER (WHERE status = 'Ausstehend') AS n,
             sum(anzahl_tx) FILTER (WHERE status = 'Ausstehend') AS tx,
             sum(anzahl_tx) FILTER (WHERE status = 'Offen') AS open_tx FROM overview GROUP BY 1)
UNION ALL
SELECT account_id, 3, 'Settlement-Übersicht', nr, 'row', concat_ws(';', nr, coalesce(strftime(datum, '%d.%m.%Y'), ''),
       anzahl_tx, {_AMOUNTS}, status), 'text;text;zahl;{_B3};text', '' FROM overview
UNION ALL
SELECT account_id, 3, 'Settlement-Übersicht', {_LAST}, 'total', concat_ws(';', 'TOTAL', '', anzahl_tx, {_AMOUNTS}, ''),
       'text;text;zahl;{_B3};text', ''
FROM (SELECT account_id, sum(anzahl_tx) AS anzahl_tx, sum(brutto) AS brutto, sum(fees) AS fees, sum(netto) AS netto
      FROM overview GROUP BY 1)
UNION ALL
SELECT account_id, nr + 3, {_NAMED}, 0, 'header', '#;Transaction ID;Connector;Brutto;Fees;Netto',
       'text;text;text;text;text;text', '' FROM overview
UNION ALL
SELECT account_id, nr + 3, {_NAMED}, tx_nr, 'row', concat_ws(';', tx_nr, transaction_id, connector, {_AMOUNTS}),
       'text;text;text;{_B3}', '' FROM detail
UNION ALL
SELECT account_id, nr + 3, {_NAMED}, anzahl_tx + 1, 'total',
       concat_ws(';', 'Subtotal (' || anzahl_tx || ' Tx)', '', '', {_AMOUNTS}), 'text;text;text;{_B3}', ''
FROM overview"""
SETTLEMENT_LINES = """
SELECT account_id, block_no, row_no, 0 AS line_no, cells AS line FROM settlement_blocks WHERE row_no <> 0
UNION ALL
SELECT account_id, block_no, row_no, unnest(range(0, len(lines))) AS line_no, unnest(lines) AS line
FROM (SELECT *, CASE WHEN block_no = 1 THEN [chr(65279) || block] ELSE ['', block] END
                || CASE WHEN note LIKE '%;%' THEN ['"' || note || '"'] WHEN note <> '' THEN [note] ELSE CAST([] AS VARCHAR[]) END
                || [cells] AS lines FROM settlement_blocks WHERE row_no = 0)"""
REFUSALS = """
SELECT account_id, count(DISTINCT datum) FILTER (WHERE status <> 'Offen') AS anzahl_settlements,
       count(*) FILTER (WHERE status <> 'Offen') AS anzahl_tx,
       CASE WHEN count(DISTINCT w) = 1 THEN coalesce(sum(netto) FILTER (WHERE status <> 'Offen'), 0) END AS netto,
       CASE WHEN count(DISTINCT w) = 1 THEN coalesce(sum(brutto) FILTER (WHERE status = 'Offen'), 0) END AS offen_brutto,
       string_agg(DISTINCT w, ',' ORDER BY w) AS waehrungen,
       CASE WHEN count(DISTINCT w) > 1 THEN 'settlement report covers several currencies (Währungen): '
            || string_agg(DISTINCT w, ', ' ORDER BY w) END AS meldung
FROM (SELECT *, CASE WHEN account_id % 2 = 1 AND transaction_id % 10 = 0 THEN 'USD' ELSE waehrung END AS w
      FROM classified) GROUP BY 1"""
DETAIL = """
SELECT c.*, o.nr, row_number() OVER (PARTITION BY c.account_id, c.status, c.datum ORDER BY c.transaction_id) AS tx_nr
FROM classified c JOIN overview o
  ON o.account_id = c.account_id AND o.status = c.status AND o.datum IS NOT DISTINCT FROM c.datum"""

EXPORT_BASE = """
b.spaceid AS space_id, b.createdon, b.completedon, b.state, b.currency, b.completedamount AS gross_amount,
coalesce(b.totalappliedfees, 0) AS processing_fees, b.completedamount - coalesce(b.totalappliedfees, 0) AS net_amount,
b.brand AS payment_connector_name, b.connector, b.terminal_identifier, b.terminal_name, b.terminal_id,
b.merchantreference AS merchant_reference"""


def _delay(window: int, withdrawals: str, account: bool) -> str:
    scope = "x.accountid = b.accountid AND" if account else ""
    return f"""
SELECT date_sub('day', b.valuedate, x.createdon) AS tage_bis_auszahlung, CAST(sum(b.n * x.n) AS BIGINT) AS anzahl
FROM (SELECT sr.accountid, bank.valuedate, count(*) AS n FROM bank JOIN tx ON tx.id = bank.transaction_id
      JOIN sr ON sr.spaceid = tx.spaceid WHERE bank.state = 'SETTLED' GROUP BY 1, 2) b
JOIN (SELECT accountid, createdon, count(*) AS n FROM w WHERE {withdrawals} GROUP BY 1, 2) x
  ON {scope} x.createdon >= b.valuedate AND x.createdon < b.valuedate + INTERVAL {window} DAY
GROUP BY 1"""


IN_PERIOD = f"createdon >= {START} AND createdon < {END}"
HAS_RECORD = "id IN (SELECT transaction_id FROM psr)"

STORED = """
SELECT 'C-' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS label,
       c_custkey % 2 = 0 AS selected,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_nationkey || ' · Filiale ' || c_nationkey END AS space,
       CASE WHEN c_custkey % 3 = 1 THEN CAST(c_nationkey AS VARCHAR) END AS space_id
FROM customer"""
DELIVERED = """
SELECT * FROM (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'N-' ELSE 'C-' END || o_custkey AS identifier,
         CASE WHEN o_orderkey % 4 <> 0 THEN 'Kasse ' || o_orderkey END AS name,
         CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 25) || ' · Filiale' END AS space,
         CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_custkey % 25 AS VARCHAR) END AS space_id
  FROM orders WHERE o_orderkey % 11 <> 0)
QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY seq) = 1"""
UPSERT = """
SELECT s.id, coalesce(d.name, s.label) AS label, s.selected, coalesce(d.space, s.space) AS space,
       coalesce(d.space_id, s.space_id) AS space_id,
       CASE WHEN d.name <> s.label OR d.space <> s.space OR (d.space_id IS NOT NULL AND d.space_id IS DISTINCT FROM s.space_id)
            THEN 'updated' ELSE 'kept' END AS change, NULL AS seq
FROM stored s LEFT JOIN delivered d ON d.identifier = s.id
UNION ALL
SELECT identifier, coalesce(name, identifier), true, coalesce(space, ''), coalesce(space_id, ''), 'new', seq
FROM delivered WHERE identifier NOT IN (SELECT id FROM stored)"""
UPSERT_TABLES = dict(stored=STORED, delivered=DELIVERED, merged=UPSERT)
OWN = "(c_nationkey = 8 AND c_custkey % 3 <> 0)"
SELECTION = f"""
SELECT s.id, s.label, s.selected OR {OWN} AS selected, s.space, s.space_id, {OWN} AND NOT s.selected AS changed
FROM stored s JOIN customer ON 'C-' || c_custkey = s.id"""
MODE = """CASE event_type WHEN 'view' THEN 'brand' WHEN 'click' THEN 'terminal' WHEN 'error' THEN 'export'
               WHEN 'purchase' THEN 'card' ELSE 'settlement' END"""
RUNS = f"SELECT *, {MODE} AS mode, 'Q-' || user_id AS token FROM events"
NEWEST = """
SELECT event_id AS seq, token, mode, ts AS submitted_at FROM runs
QUALIFY row_number() OVER (PARTITION BY token ORDER BY event_id DESC) = 1 ORDER BY seq DESC LIMIT 50"""
_TERMINALS = "CAST(event_id % 2 = 1 AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER)"
_ACCOUNT = "CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN CAST(user_id % 5 AS VARCHAR) ELSE '' END"
RUN_LOG = f"""
SELECT token, mode, CASE mode WHEN 'brand' THEN 'Brand-Auswertung' WHEN 'terminal' THEN 'Terminal-Report'
         WHEN 'export' THEN 'Transaktions-Export' WHEN 'card' THEN 'Kartensuche' ELSE 'Settlement / Auszahlung' END AS mode_label,
       ts AS submitted_at, CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CASE WHEN mode <> 'settlement' THEN (user_id % 7) || CASE WHEN event_id % 2 = 0 THEN ', ' || (user_id % 5) ELSE '' END
            WHEN {_ACCOUNT} = '' THEN 'hinterlegter Account' ELSE 'Account ' || {_ACCOUNT} END AS spaces_summary,
       strftime(ts, '%Y-%m-%d') || ' – ' || strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d') AS timeframe_summary,
       CASE WHEN mode = 'settlement' THEN '' ELSE concat_ws(' · ',
            CASE WHEN mode = 'card' THEN 'Karte ' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') END,
            CASE WHEN {_TERMINALS} > 0 THEN ({_TERMINALS}) || ' Terminal(s)' END) END AS filter_summary,
       {_ACCOUNT} AS account
FROM runs"""
ANSWERS = """
SELECT 'tok-' || event_id AS token,
       CASE WHEN event_id % 3 = 2 THEN '' WHEN event_id % 4 = 0 THEN 'SUCCESS' WHEN event_id % 4 = 1 THEN 'PROCESSING'
            ELSE 'FAILED' END AS status FROM events"""
CH = "’"
NESTED = """
SELECT waehrung, outlet, tid, min(name) AS name, sum(complete_demand) AS complete_demand, sum(tip) AS tip,
       CAST(sum(unmatched) AS BIGINT) AS unmatched, CAST(sum(count) AS BIGINT) AS count,
       string_agg(brand || ' (' || brand_group || '): ' || CAST(CAST(complete_demand AS DECIMAL(38,8)) AS VARCHAR) || ' / ' || count,
                  '; ' ORDER BY brand) AS brands
FROM groups WHERE level = 'detail' GROUP BY 1, 2, 3"""
CELL_TYPES = """
SELECT block_no, block, row_no, unnest(range(0, len(c))) AS column_no, unnest(c) AS cell, unnest(string_split(types, ';')) AS cell_type
FROM (SELECT *, string_split(cells, ';') AS c FROM terminal_blocks)"""
RAGGED = """
SELECT p_partkey AS part, len(c) AS width, array_to_string(c, '|') AS text
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [k, p_name] WHEN 1 THEN [k]
             WHEN 2 THEN [k, p_brand, 'x, "' || p_type || '"' || chr(10) || chr(10) || p_size, '']
             ELSE [k, '', p_name || chr(13) || chr(10), p_brand, 'ü'] END AS c
      FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part))"""
AMOUNTS_READ = """
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,8))
       WHEN 1 THEN CAST(o_orderkey AS DECIMAL(38,8)) WHEN 2 THEN CAST('-7.' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS DECIMAL(38,8))
       WHEN 5 THEN CAST(o_orderkey || '.5' AS DECIMAL(38,8)) WHEN 6 THEN CAST('0.' || (o_orderkey % 10) AS DECIMAL(38,8))
       ELSE CAST(0 AS DECIMAL(38,8)) END AS amount FROM orders"""
UNASSIGNED = """
SELECT sr.accountid AS account_id, count(*) AS anzahl_tx, sum(tx.completedamount) AS brutto,
       count(*) FILTER (WHERE s.transaction_id IS NULL) AS offen
FROM tx LEFT JOIN (SELECT * FROM sr WHERE spaceid % 3 <> 0) sr ON sr.spaceid = tx.spaceid
     LEFT JOIN settle s ON s.transaction_id = tx.id GROUP BY 1"""


def _swiss(amount: str) -> str:
    return f"replace(format('{{:,.2f}}', CAST(round({amount}, 2) AS DOUBLE)), ',', '{CH}')"


def _displayed(cells: str, types: str) -> str:
    numbers = f"{_swiss('complete_demand')}, {_swiss('tip')}, replace(format('{{:,}}', unmatched), ',', '{CH}'), replace(format('{{:,}}', count), ',', '{CH}')"
    shown = TERMINAL_BLOCKS.replace(_GROUP_NUMBERS, numbers)
    return f"""
SELECT waehrung, block_no, row_no, kind, {cells} AS cells,
       array_to_string(list_transform(string_split({types}, ';'), lambda x: CASE WHEN x = 'text' THEN 'left' ELSE 'right' END), ';') AS alignment
FROM ({shown})"""


ORACLE = {
    "brand_report": with_tables(
        f"""SELECT spaceid AS space_id, brand, currency AS waehrung, {_MEASURES}
FROM branded LEFT JOIN tip ON tip.transaction_id = branded.id GROUP BY 1, 2, 3""", **SIDES),
    "terminal_report": with_tables(TERMINAL_ROWS, **SIDES),
    "transaction_export": with_tables(
        f"""SELECT {EXPORT_BASE}, s.valuedate AS auszahlungsdatum, p.settlement_reference, c.masked_card, c.auth_code,
       s.settlement_state, coalesce(tip.tip_amount, 0) AS tip_amount,
       b.completedamount - coalesce(tip.tip_amount, 0) AS gross_excl_tip
FROM branded b LEFT JOIN settle s ON s.transaction_id = b.id LEFT JOIN payout p ON p.transaction_id = b.id
     LEFT JOIN card c ON c.transaction_id = b.id LEFT JOIN tip ON tip.transaction_id = b.id""", **SIDES),
    "transaction_export_terminals": with_tables(
        f"""SELECT {EXPORT_BASE}, s.valuedate AS auszahlungsdatum, c.masked_card, c.auth_code, s.settlement_state
FROM branded b LEFT JOIN settle s ON s.transaction_id = b.id LEFT JOIN card c ON c.transaction_id = b.id
WHERE b.terminal_identifier IS NOT NULL""", **SIDES),
    "card_search_terminals": with_tables(
        """SELECT b.spaceid AS space_id, b.completedon, b.terminal_identifier, b.terminal_name,
       b.completedamount AS gross_amount, b.currency AS waehrung, b.brand, c.masked_card, c.auth_code,
       b.id AS transaction_id, b.state
FROM branded b JOIN card c ON c.transaction_id = b.id
WHERE b.terminal_identifier IS NOT NULL AND c.masked_card LIKE '%77'""", **SIDES),
    "transaction_export_default": with_tables(
        f"""SELECT {EXPORT_BASE}, s.valuedate AS auszahlungsdatum, c.masked_card, c.auth_code, s.settlement_state
FROM branded b LEFT JOIN settle s ON s.transaction_id = b.id LEFT JOIN card c ON c.transaction_id = b.id""", **SIDES),
    "card_search": with_tables(
        """SELECT b.spaceid AS space_id, b.completedon, b.terminal_identifier, b.terminal_name,
       b.completedamount AS gross_amount, b.currency AS waehrung, b.brand, c.masked_card, c.auth_code,
       b.id AS transaction_id, b.state
FROM branded b JOIN card c ON c.transaction_id = b.id
WHERE c.masked_card LIKE '%77'""", **SIDES),
    "settlement_transactions": with_tables(
        "SELECT * EXCLUDE (account_id) REPLACE (CAST(settlement_datum AS VARCHAR) AS settlement_datum) FROM settlement_rows",
        **MODEL),
    "settlement_reference_sample": with_tables(
        f"""SELECT {EXPORT_BASE}, s.valuedate AS auszahlungsdatum, s.internalreference AS settlement_reference,
       c.masked_card, c.auth_code
FROM branded b LEFT JOIN card c ON c.transaction_id = b.id LEFT JOIN (
  SELECT l.transaction_id, l.valuedate, w.internalreference
  FROM (SELECT transaction_id, max(valuedate) AS valuedate FROM bank WHERE state = 'SETTLED' GROUP BY 1) l
  ASOF LEFT JOIN w ON w.createdon >= l.valuedate) s ON s.transaction_id = b.id""", **SIDES),
    "terminal_group_report": with_tables("SELECT * FROM groups", **GROUPS),
    "terminal_csv_roundtrip": with_tables("SELECT * FROM groups", **GROUPS),
    "terminal_group_report_nested": with_tables(NESTED, **GROUPS),
    "terminal_report_order": with_tables(
        """SELECT level, waehrung, outlet, brand_group, tid, brand, row_number() OVER (ORDER BY
       CASE level WHEN 'outlet' THEN 1 WHEN 'brand_group' THEN 2 WHEN 'grand_total' THEN 3 ELSE 4 END, waehrung,
       outlet NULLS FIRST, brand_group NULLS FIRST, name NULLS FIRST, tid NULLS FIRST, brand NULLS FIRST) AS position FROM groups""", **GROUPS),
    "settlement_connector_order": with_tables(
        """SELECT account_id, connector, row_number() OVER (PARTITION BY account_id ORDER BY brutto DESC, connector) AS position
FROM connectors""", **MODEL),
    "terminal_csv_defaults": with_tables(
        """SELECT terminal_identifier, terminal_name, brand, 'CHF' AS waehrung, CAST(0 AS BIGINT) AS anzahl_transaktionen,
       unsettled_anzahl, brutto_gross, tip_total FROM terminal_rows""", **SIDES, terminal_rows=TERMINAL_ROWS),
    "csv_cells_ragged": RAGGED,
    "display_cells": with_tables(_displayed("cells", "types"), **GROUPS),
    "cell_types": with_tables(CELL_TYPES, **GROUPS, terminal_blocks=TERMINAL_BLOCKS),
    "settlement_unassigned_spaces": with_tables(UNASSIGNED, tx=TX, bank=BANK, settle=SETTLE),
    "amount_reader": AMOUNTS_READ,
    "terminal_list_saved": with_tables("SELECT id, label, selected, space, space_id FROM merged", **UPSERT_TABLES),
    "terminal_group_report_mapped": with_tables(
        _groups(SAVED_OUTLET, SAVED_GROUP), **SIDES, terminal_rows=TERMINAL_ROWS),
    "merged_outlets": with_tables(
        f"SELECT DISTINCT terminal_identifier, {SAVED_OUTLET} AS outlet FROM terminal_rows",
        **SIDES, terminal_rows=TERMINAL_ROWS),
    "merged_brand_groups": with_tables(
        f"SELECT DISTINCT brand, {SAVED_GROUP} AS brand_group FROM terminal_rows",
        **SIDES, terminal_rows=TERMINAL_ROWS),
    "terminal_export_blocks": with_tables(TERMINAL_BLOCKS, **GROUPS),
    "terminal_report_lines": with_tables(TERMINAL_LINES, **GROUPS, terminal_blocks=TERMINAL_BLOCKS),
    "settlement_overview": with_tables(
        "SELECT * REPLACE (CAST(datum AS VARCHAR) AS datum) FROM overview", **MODEL),
    "settlement_csv_roundtrip": with_tables(
        f"SELECT * REPLACE (CAST(datum AS VARCHAR) AS datum) FROM ({_overview('space_id')})", **MODEL),
    "settlement_kpis": with_tables(
        "SELECT *, CASE WHEN account_id = 0 THEN 'EUR' ELSE 'CHF' END AS waehrungen FROM averaged", **MODEL),
    "settlement_connectors": with_tables("SELECT * FROM connectors", **MODEL),
    "settlement_connector_total": with_tables(
        """SELECT account_id, CAST(sum(anzahl_tx) AS BIGINT) AS anzahl_tx, sum(brutto) AS brutto, sum(fees) AS fees,
       sum(netto) AS netto FROM connectors GROUP BY 1""", **MODEL),
    "settlement_pending": with_tables(
        """SELECT account_id, count(*) FILTER (WHERE status = 'Ausstehend') AS anzahl_settlements,
       CAST(coalesce(sum(anzahl_tx) FILTER (WHERE status = 'Ausstehend'), 0) AS BIGINT) AS anzahl_tx,
       coalesce(sum(brutto) FILTER (WHERE status = 'Ausstehend'), 0) AS brutto,
       coalesce(sum(netto) FILTER (WHERE status = 'Ausstehend'), 0) AS netto FROM overview GROUP BY 1""", **MODEL),
    "settlement_totals": with_tables(
        """SELECT account_id, count(*) AS anzahl_tx, sum(brutto) AS brutto, sum(fees) AS fees, sum(netto) AS netto
FROM classified GROUP BY 1""", **MODEL),
    "settlement_detail": with_tables(
        """SELECT account_id, nr AS settlement_nr, CAST(datum AS VARCHAR) AS datum, status, tx_nr AS nr, transaction_id,
       connector, brutto, fees, netto FROM detail""", **MODEL, detail=DETAIL),
    "settlement_export_blocks": with_tables(SETTLEMENT_BLOCKS, **MODEL, detail=DETAIL),
    "settlement_report_lines": with_tables(SETTLEMENT_LINES, **MODEL, detail=DETAIL, settlement_blocks=SETTLEMENT_BLOCKS),
    "settlement_refusals": with_tables(REFUSALS, **MODEL),
    "tip_per_transaction": with_tables(TIP, tx=TX),
    "card_per_transaction": with_tables(CARD, tx=TX),
    "settlement_per_transaction": with_tables(SETTLE, tx=TX, bank=BANK),
    "payout_reference": with_tables(PAYOUT, tx=TX, bank=BANK),
    "bank_states": with_tables(
        """SELECT state AS zustand, count(*) AS anzahl, count(valuedate) AS mit_valuedate,
       count(*) FILTER (WHERE valuedate IS NULL) AS ohne_valuedate, min(valuedate) AS frueheste_valuta,
       max(valuedate) AS spaeteste_valuta FROM bank GROUP BY 1""", tx=TX, bank=BANK),
    "fee_sign_check": with_tables(
        """SELECT state AS zustand, count(*) AS anzahl, sum(postingamount) AS summe_postingamount,
       sum(valueamount) AS summe_valueamount, sum(fee) AS summe_differenz, min(fee) AS min_differenz,
       max(fee) AS max_differenz, count(*) FILTER (WHERE fee < 0) AS anzahl_negativ,
       count(*) FILTER (WHERE fee = 0) AS anzahl_null
FROM (SELECT *, postingamount - valueamount AS fee FROM bank) GROUP BY 1""", tx=TX, bank=BANK),
    "payout_delay_all": with_tables(
        _delay(45, f"createdon >= {START} AND createdon < {END} + INTERVAL 45 DAY", False), tx=TX, bank=BANK),
    "payout_delay_prefiltered": with_tables(_delay(15, IN_PERIOD, False), tx=TX, bank=BANK),
    "payout_delay_account": with_tables(_delay(30, IN_PERIOD, True), tx=TX, bank=BANK),
    "records_per_transaction": with_tables(
        """SELECT records_pro_transaktion, count(*) AS anzahl_transaktionen FROM (
  SELECT count(*) AS records_pro_transaktion FROM psr WHERE transaction_id IN (SELECT id FROM tx) GROUP BY transaction_id)
GROUP BY 1""", tx=TX),
    "settlement_coverage": with_tables(
        f"""SELECT count(*) AS anzahl_transaktionen, count(*) FILTER (WHERE {HAS_RECORD}) AS anzahl_mit_record,
       count(*) FILTER (WHERE NOT {HAS_RECORD}) AS anzahl_ohne_record FROM tx""", tx=TX),
    "fee_record_matrix": with_tables(
        f"""SELECT CASE WHEN coalesce(totalappliedfees, 0) = 0 THEN 'ohne' ELSE 'mit' END || ' Gebuehr' AS gebuehr,
       CASE WHEN {HAS_RECORD} THEN 'mit' ELSE 'ohne' END || ' Record' AS settlement, count(*) AS anzahl
FROM tx GROUP BY 1, 2""", tx=TX),
    "withdrawal_count": with_tables(
        f"SELECT count(*) AS anzahl_auszahlungen, min(createdon) AS frueheste, max(createdon) AS spaeteste FROM w WHERE {IN_PERIOD}"),
    "withdrawal_count_account": with_tables(
        f"""SELECT count(*) AS anzahl_auszahlungen, count(DISTINCT accountid) AS anzahl_accounts,
       min(createdon) AS frueheste, max(createdon) AS spaeteste
FROM w WHERE {IN_PERIOD} AND accountid IN (SELECT accountid FROM sr)"""),
    "settlement_record_count": with_tables("SELECT count(*) AS settle_records FROM bank", tx=TX, bank=BANK),
    "bank_reference_sample": with_tables(
        """SELECT transaction_id, banktransaction_id, reference, paymentdate FROM bank
ORDER BY transaction_id, banktransaction_id LIMIT 50""", tx=TX, bank=BANK),
    "lineitem_types": with_tables(
        "SELECT type, count(*) AS anzahl_lineitems, sum(amountincludingtax) AS summe FROM li GROUP BY 1"),
    "tip_inclusion_check": with_tables(
        """SELECT tx.id, tx.completedamount, x.tip, x.lineitems_total, tx.completedamount - x.lineitems_total AS differenz_brutto_zu_lineitems
FROM tx JOIN (SELECT tl.transaction_id, sum(amountincludingtax) AS lineitems_total,
                     sum(amountincludingtax) FILTER (WHERE type = 'TIP') AS tip
              FROM tl JOIN li ON li.id = tl.lineitems_id AND li.spaceid = tl.spaceid GROUP BY 1) x ON x.transaction_id = tx.id
WHERE x.tip > 0 ORDER BY tx.id LIMIT 50""", tx=TX),
    "amount_texts": with_tables(
        f"""SELECT id, {_swiss('completedamount')} AS gross_text, {_swiss('completedamount * -0.0095')} AS fee_text,
       {_plain('completedamount * -0.0095')} AS fee_plain, replace(format('{{:,}}', id), ',', '{CH}') AS id_text FROM t"""),
    "outlet_names": """
SELECT CASE WHEN c_custkey % 7 = 0 THEN '–' WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR)
            WHEN c_custkey % 3 = 0 THEN 'Bar ' || c_custkey || ' ' || c_mktsegment ELSE c_mktsegment END AS outlet,
       count(*) AS terminals FROM customer GROUP BY 1""",
    "terminal_upsert": with_tables("SELECT * FROM merged", **UPSERT_TABLES),
    "terminal_upsert_counts": with_tables(
        """SELECT count(*) FILTER (WHERE change = 'new') AS neu, count(*) FILTER (WHERE change = 'updated') AS aktualisiert
FROM merged""", **UPSERT_TABLES),
    "terminal_selection": with_tables(SELECTION, stored=STORED),
    "terminal_selection_count": with_tables(
        f"SELECT count(*) FILTER (WHERE changed) AS geaendert FROM ({SELECTION})", stored=STORED),
    "terminal_records": """
SELECT CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'T-' || c_custkey END AS identifier,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name,
       CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS id,
       CASE WHEN c_custkey % 2 = 0 THEN 'ACTIVE' ELSE '' END AS state FROM customer""",
    "run_log": with_tables(RUN_LOG, runs=RUNS),
    "run_answers": f"""
SELECT token, status, status IN ('SUCCESS', 'FAILED', 'CANCELLED') AS is_final, status = 'SUCCESS' AS is_success
FROM ({ANSWERS})""",
    "newest_runs": with_tables(NEWEST, runs=RUNS),
    "newest_runs_of_mode": with_tables(f"SELECT * FROM ({NEWEST}) WHERE mode = 'card'", runs=RUNS),
}
ORACLE["transaction_export_stored"] = ORACLE["transaction_export"]

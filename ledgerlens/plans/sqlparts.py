"""DuckDB oracle building blocks: the fixture views spelled in plain SQL."""

TXN_CTE = """
txn0 AS (
  SELECT user_id AS account_id, CAST(event_id AS VARCHAR) AS txn_id, event_id AS seq,
         CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS date,
         strftime(ts, '%H:%M:%S') AS time,
         CASE WHEN event_type = 'signup' THEN 'Credit' ELSE 'Debit' END AS debit_credit,
         CAST(round(value * 100) AS DECIMAL(18,2)) AS amount,
         CASE event_type WHEN 'click' THEN 'UPI' WHEN 'view' THEN 'CARD' WHEN 'purchase' THEN 'POS'
                         WHEN 'error' THEN 'ATM' WHEN 'signup' THEN 'NEFT' END AS mode,
         'M' || json_extract_string(props, '$.k') AS merchant
  FROM events),
txn AS (
  SELECT account_id, txn_id, seq, ts, date, time, debit_credit, amount,
         CAST(200000 + sum(CASE WHEN debit_credit = 'Credit' THEN amount ELSE -amount END)
              OVER (PARTITION BY account_id ORDER BY ts, seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance,
         mode AS transaction_type, mode, merchant, mode || '/' || merchant AS narration
  FROM txn0)"""


def with_txn(body: str, *more_ctes: str) -> str:
    ctes = ",\n".join([TXN_CTE.strip(), *[c.strip() for c in more_ctes]])
    return f"WITH {ctes}\n{body.strip()}"


def fmt2(x: str) -> str:
    """SQL twin of Python f'{x:,.2f}'."""
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def fmt1_plain(x: str) -> str:
    return f"format('{{:.1f}}', CAST({x} AS DOUBLE))"


TXN_ORDERS_CTE = """
txn_orders0 AS (
  SELECT o_custkey AS account_id, CAST(o_orderkey AS VARCHAR) AS txn_id, o_orderkey AS seq,
         CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderdate AS DATE) AS date,
         strftime(o_orderdate, '%H:%M:%S') AS time,
         CASE WHEN o_orderstatus = 'F' THEN 'Credit' ELSE 'Debit' END AS debit_credit,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS transaction_type,
         o_orderpriority AS mode, o_orderstatus AS merchant, o_orderpriority || '/' || o_orderstatus AS narration
  FROM orders),
txn_orders AS (
  SELECT t.account_id, txn_id, seq, ts, date, time, debit_credit, amount,
         CAST(coalesce(CAST(c.c_acctbal AS DECIMAL(18,2)), 0) + sum(CASE WHEN debit_credit = 'Credit' THEN amount ELSE -amount END)
              OVER (PARTITION BY t.account_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance,
         transaction_type, mode, merchant, narration
  FROM txn_orders0 t LEFT JOIN customer c ON t.account_id = c.c_custkey)"""


TXN_LINEITEM_CTE = """
txn_lineitem0 AS (
  SELECT l_suppkey AS account_id, CAST(((l_orderkey * 8 + l_linenumber) << 24) + l_partkey AS VARCHAR) AS txn_id,
         ((l_orderkey * 8 + l_linenumber) << 24) + l_partkey AS seq,
         CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_shipdate AS DATE) AS date, strftime(l_shipdate, '%H:%M:%S') AS time,
         CASE WHEN l_returnflag = 'R' THEN 'Credit' ELSE 'Debit' END AS debit_credit,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_linestatus AS transaction_type, l_linestatus AS mode,
         'P' || CAST(l_partkey AS VARCHAR) AS merchant, l_linestatus || '/P' || CAST(l_partkey AS VARCHAR) AS narration
  FROM lineitem),
txn_lineitem AS (
  SELECT account_id, txn_id, seq, ts, date, time, debit_credit, amount,
         CAST(10000000 + sum(CASE WHEN debit_credit = 'Credit' THEN amount ELSE -amount END)
              OVER (PARTITION BY account_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance,
         transaction_type, mode, merchant, narration
  FROM txn_lineitem0)"""

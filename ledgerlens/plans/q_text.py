"""Registered statement-text queries: statements rendered from
``txn`` by Spark, parsed back; the oracle states parse(render(x)) = x."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import textlines as TL
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources import statements as SS
from ledgerlens.session import materialized
from ledgerlens.sources.tables import _src, txn


def lines_table(spark, sf_dir, kind):
    """The statement-lines input table (rendered from txn by Spark) stored
    once, as a statement pipeline stores extracted lines."""
    render = {"dated": SS.render_dated_lines, "layout": SS.render_layout_lines,
              "context": SS.render_context_lines}[kind]
    return materialized(spark, f"lines_{kind}", _src(sf_dir, "events"), lambda: render(txn(spark, sf_dir)))

_BODY = ("CASE WHEN debit_credit = 'Credit' THEN 'NEFT CR-' || merchant ELSE mode || '/' || merchant END"
         " || CASE WHEN seq % 3 = 0 THEN ' REF' ELSE '' END")


@register("txt_parse_dated", with_txn(f"""
SELECT account_id AS doc_id, seq * 3 AS first_line,
       CASE WHEN debit_credit = 'Credit' THEN 'CR' ELSE 'DR' END AS debit_credit,
       format('{{:,.2f}}', CAST(amount AS DOUBLE)) AS amount, format('{{:,.2f}}', CAST(balance AS DOUBLE)) AS balance,
       strftime(ts, '%d-%m-%Y') AS date, strftime(ts, '%H:%M') AS time,
       CASE WHEN debit_credit = 'Credit' THEN 'NEFT' WHEN mode IN ('UPI', 'POS', 'ATM') THEN mode ELSE 'CARD/' || merchant END AS transaction_type,
       {_BODY} AS merchant
FROM txn"""))
def txt_parse_dated(spark, sf_dir):
    """Dated-line statement text -> transactions (blocks, amounts, balance,
    merchant cleanup, DR/CR, type prefix)."""
    p = TL.parse_dated(TL.group_dated(lines_table(spark, sf_dir, "dated")))
    return p.drop("block_no")


@register("txt_group_dated", with_txn("""
SELECT account_id AS doc_id, count(*) AS blocks FROM txn GROUP BY account_id"""))
def txt_group_dated(spark, sf_dir):
    """Number of transaction blocks per document (title lines dropped)."""
    return TL.group_dated(lines_table(spark, sf_dir, "dated")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))


@register("txt_quality", with_txn("""
SELECT account_id AS doc_id, count(*) AS rows, count(*) AS valid_dates, count(*) AS valid_amounts,
       count(*) AS valid_balances FROM txn GROUP BY account_id"""))
def txt_quality(spark, sf_dir):
    """Parsed rows and valid date / amount / balance counts per document."""
    return TL.quality(TL.parse_dated(TL.group_dated(lines_table(spark, sf_dir, "dated"))))


@register("txn_dedupe", with_txn("""
SELECT account_id AS doc_id, seq * 3 AS first_line FROM
  (SELECT *, row_number() OVER (PARTITION BY account_id, amount, balance ORDER BY seq) AS rn FROM txn) WHERE rn = 1"""))
def txn_dedupe(spark, sf_dir):
    """First row per (document, amount, balance) of the parsed statement."""
    p = TL.parse_dated(TL.group_dated(lines_table(spark, sf_dir, "dated")))
    return TL.dedupe(p).select("doc_id", "first_line")


@register("txt_parse_layout", with_txn("""
SELECT account_id AS doc_id, seq * 4 AS first_line,
       CASE WHEN amount = 0 THEN 'DEBIT' WHEN debit_credit = 'Credit' THEN 'CREDIT' ELSE 'DEBIT' END AS debit_credit,
       CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance, strftime(date, '%d %b %y') AS date,
       strftime(ts, '%H:%M:%S') AS time,
       CASE mode WHEN 'UPI' THEN 'UPI' WHEN 'ATM' THEN 'ATM_WITHDRAWAL' WHEN 'POS' THEN 'PURCHASE'
                 WHEN 'CARD' THEN 'IMPS' ELSE 'NEFT' END AS transaction_type,
       CASE WHEN mode = 'ATM' THEN '' ELSE merchant END AS merchant
FROM txn"""))
def txt_parse_layout(spark, sf_dir):
    """Table-layout statement -> transactions: grouped descriptions, as-of
    date labels by y, amount/side from the balance delta across pages."""
    return TL.parse_layout(lines_table(spark, sf_dir, "layout")).drop("block_no")


@register("txt_parse_context", with_txn("""
SELECT account_id AS doc_id, seq * 2 AS line_no, strftime(date, '%d-%m-%Y') AS date, CAST(amount AS DOUBLE) AS amount,
       CASE WHEN n = '' THEN 'UNKNOWN' ELSE n END AS narration,
       -(CAST(balance AS DOUBLE) + 1000000) AS balance,
       CASE WHEN mode IN ('UPI', 'POS', 'ATM', 'NEFT') THEN mode ELSE 'NEFT' END AS mode, 'DEBIT' AS debit_credit
FROM (SELECT *, concat_ws(' ', CASE WHEN first_row THEN 'ACCOUNT STATEMENT' END,
                          CASE WHEN mode NOT IN ('UPI', 'NEFT') THEN mode END, 'TRANSFER',
                          CASE WHEN length(merchant) >= 3 THEN merchant END) AS n,
             row_number() OVER (PARTITION BY account_id, amount, balance ORDER BY seq) AS rn
      FROM (SELECT *, seq = min(seq) OVER (PARTITION BY account_id) AS first_row FROM txn)
      WHERE amount >= 1000 AND amount < 500000 AND balance + 1000000 >= 500000)
WHERE rn = 1"""))
def txt_parse_context(spark, sf_dir):
    """Context-line statement text: dated lines with look-ahead amounts,
    amount / balance split, narration cleanup, mode, dedupe."""
    p = TL.parse_context(lines_table(spark, sf_dir, "context"))
    return TL.dedupe_first(p)


@register("txt_context_rejects", with_txn("""
SELECT account_id AS doc_id, seq * 2 AS line_no, strftime(date, '%d-%m-%Y') AS date,
       'balance only' AS reject
FROM txn WHERE amount < 1000 OR amount >= 500000"""))
def txt_context_rejects(spark, sf_dir):
    """Dated context lines whose amount carries no comma group, or is as large as a
    balance: not dropped silently, but returned with the reason."""
    return TL.context_rejects(lines_table(spark, sf_dir, "context")).select("doc_id", "line_no", "date", "reject")


@register("txt_header_map", with_txn("""
SELECT account_id AS doc_id, c.col_idx, c.field FROM (SELECT DISTINCT account_id FROM txn) d,
  (VALUES (0, 'date'), (1, 'narration'), (2, 'debit'), (3, 'credit'), (4, 'balance')) c(col_idx, field)"""))
def txt_header_map(spark, sf_dir):
    """Best bank header map per document (most hits, >= 2)."""
    headers, _ = SS.render_table_cells(txn(spark, sf_dir))
    return TL.header_map(headers)


@register("txt_merge_debit_credit", with_txn("""
SELECT account_id AS doc_id, seq AS row_no, strftime(date, '%Y-%m-%d') AS date, CAST(amount AS DOUBLE) AS amount,
       narration, CAST(balance AS DOUBLE) AS balance, 'UNKNOWN' AS mode,
       CASE WHEN debit_credit = 'Credit' AND amount > 0 THEN 'CREDIT' ELSE 'DEBIT' END AS debit_credit
FROM txn"""))
def txt_merge_debit_credit(spark, sf_dir):
    """Digital table rows: mapped cells pivoted, debit/credit merged into
    amount + side, day-first dates parsed."""
    headers, cells = SS.render_table_cells(txn(spark, sf_dir))
    return TL.merge_table_rows(cells, TL.header_map(headers))

"""Registered profiling / KPI / series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import analytics as A
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources.tables import CANON, txn

AVG = "CAST(sum(amount) AS DOUBLE) / count(amount)"
DEBIT = "trim(debit_credit) = 'Debit'"
CREDIT = "trim(debit_credit) = 'Credit'"


_ALL_NULLS = " + ".join(f"(count(*) - count({c}))" for c in CANON)


@register("profile_table", with_txn(f"""
SELECT count(*) AS rows, {len(CANON)} AS columns, {_ALL_NULLS} AS total_nulls,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(CANON)} FROM txn)) AS duplicate_rows
FROM txn"""))
def profile_table(spark, sf_dir):
    """Rows, columns, null cells and duplicate rows of the whole table."""
    return A.profile_table(txn(spark, sf_dir))


@register("profile_table_edges", with_txn(f"""
SELECT count(*) AS rows, {len(CANON)} AS columns, {_ALL_NULLS} AS total_nulls,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(CANON)} FROM e)) AS duplicate_rows
FROM e""", f"""e AS (SELECT {", ".join(f"CASE WHEN seq % 5 = 0 THEN NULL ELSE {c} END AS {c}" if c == "merchant" else c for c in CANON)}
FROM (SELECT * FROM txn UNION ALL SELECT * FROM txn WHERE seq % 10 = 3))"""))
def profile_table_edges(spark, sf_dir):
    """The same over a table with repeated rows and empty merchants."""
    t = txn(spark, sf_dir)
    e = t.unionByName(t.where(F.pmod(F.col("seq"), F.lit(10)) == 3))
    return A.profile_table(e.withColumn("merchant", F.when(F.pmod(F.col("seq"), F.lit(5)) != 0, F.col("merchant"))))


_TYPES = {"account_id": "bigint", "txn_id": "string", "seq": "bigint", "ts": "timestamp",
          "date": "date", "time": "string", "debit_credit": "string", "amount": "decimal(18,2)",
          "balance": "decimal(18,2)", "transaction_type": "string", "mode": "string",
          "merchant": "string", "narration": "string"}
_PROFILE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{_TYPES[c]}' AS dtype, count({c}) AS non_null, "
    f"CAST(first({c} ORDER BY seq) FILTER (WHERE {c} IS NOT NULL) AS VARCHAR) AS sample FROM txn"
    for c in CANON)


@register("profile_columns", with_txn(_PROFILE_SQL))
def profile_columns(spark, sf_dir):
    """Per column: type, non-null count, first non-null value by statement order."""
    return A.profile_columns(txn(spark, sf_dir))


_EXTRA = ",".join(sorted(set(CANON) - set(A.EXPECTED_COLUMNS)))
_NULLS = ", ".join(f"count(*) - count({c}) AS null_{c}" for c in sorted(A.EXPECTED_COLUMNS))


@register("validate_schema", with_txn(f"""
SELECT true AS valid, '' AS missing_cols, '{_EXTRA}' AS extra_cols, count(*) AS row_count, {_NULLS}
FROM txn"""))
def validate_schema(spark, sf_dir):
    """Expected-column contract: missing/extra names, rows, nulls per column."""
    return A.validate_schema(txn(spark, sf_dir))


@register("kpis", with_txn(f"""
SELECT account_id,
       CAST(coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE) AS total_debit,
       CAST(coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) AS DOUBLE) AS total_credit,
       count(*) AS transaction_count, {AVG} AS average_transaction,
       median(CAST(amount AS DOUBLE)) AS median_transaction
FROM txn GROUP BY account_id"""))
def kpis(spark, sf_dir):
    """total_debit, total_credit, transaction_count, average and median per account."""
    return A.kpis(txn(spark, sf_dir))


@register("summary_statistics", with_txn(f"""
SELECT account_id, count(*) AS transaction_count,
       CAST(coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE) AS total_debit,
       CAST(coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) AS DOUBLE) AS total_credit,
       CAST(coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) - coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE) AS net_cash_flow,
       {AVG} AS average_transaction, median(CAST(amount AS DOUBLE)) AS median_transaction,
       CAST(max(CASE WHEN {DEBIT} THEN amount END) AS DOUBLE) AS largest_debit,
       CAST(max(CASE WHEN {CREDIT} THEN amount END) AS DOUBLE) AS largest_credit,
       stddev_samp(CAST(amount AS DOUBLE)) AS std_dev,
       CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount,
       CAST(last(balance ORDER BY seq) FILTER (WHERE balance IS NOT NULL) AS DOUBLE) AS closing_balance,
       CASE WHEN max(date) IS NOT NULL THEN CAST(coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE)
            / greatest(date_diff('day', min(date), max(date)), 1) END AS average_daily_spending
FROM txn GROUP BY account_id"""))
def summary_statistics(spark, sf_dir):
    """Thirteen summary statistics per account."""
    return A.summary_statistics(txn(spark, sf_dir))


def _mode_sql(c):
    return (f"(SELECT {c} FROM (SELECT account_id AS a, {c}, count(*) AS n FROM txn WHERE {c} IS NOT NULL GROUP BY 1, 2) "
            f"WHERE a = t.account_id ORDER BY n DESC, {c} ASC LIMIT 1)")


@register("summary_g1", with_txn(f"""
SELECT account_id, CAST(sum(amount) AS DOUBLE) AS total_amount, {AVG} AS avg_amount,
       CAST(max(amount) AS DOUBLE) AS max_amount, CAST(min(amount) AS DOUBLE) AS min_amount,
       CAST(coalesce(sum(CASE WHEN upper(trim(debit_credit)) = 'DEBIT' THEN amount END), 0) AS DOUBLE) AS debit_total,
       CAST(coalesce(sum(CASE WHEN upper(trim(debit_credit)) = 'CREDIT' THEN amount END), 0) AS DOUBLE) AS credit_total,
       count(*) AS transactions, {_mode_sql('transaction_type')} AS top_type,
       {_mode_sql('merchant')} AS top_merchant
FROM txn t GROUP BY account_id"""))
def summary_g1(spark, sf_dir):
    """Statement-demo summary with modal type and merchant (ties: smallest)."""
    return A.summary_g1(txn(spark, sf_dir))


@register("daily_volume", with_txn("""
SELECT account_id, strftime(date, '%Y-%m-%d') AS date, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount,
       count(amount) AS count
FROM txn WHERE date IS NOT NULL GROUP BY account_id, date"""))
def daily_volume(spark, sf_dir):
    """Per account and day: total amount and count."""
    return A.daily_volume(txn(spark, sf_dir))


@register("monthly_trends", with_txn(f"""
SELECT account_id, strftime(date, '%Y-%m') AS month,
       CAST(coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE) AS total_debit,
       CAST(coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) AS DOUBLE) AS total_credit,
       count(*) AS count,
       CAST(coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) - coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE) AS net
FROM txn WHERE date IS NOT NULL GROUP BY account_id, strftime(date, '%Y-%m')"""))
def monthly_trends(spark, sf_dir):
    """Per account and month: debit, credit, net, count (long history view)."""
    return A.monthly_trends(txn(spark, sf_dir))


_DCA_G = """
g AS (SELECT account_id, count(*) AS n, sum(amount) AS all_amt,
        coalesce(sum(CASE WHEN trim(debit_credit) = 'Debit' THEN amount END), 0) AS d_total,
        count(CASE WHEN trim(debit_credit) = 'Debit' THEN 1 END) AS d_count,
        coalesce(sum(CASE WHEN trim(debit_credit) = 'Credit' THEN amount END), 0) AS c_total,
        count(CASE WHEN trim(debit_credit) = 'Credit' THEN 1 END) AS c_count FROM txn GROUP BY account_id)"""
_DCA_S = """
s AS (SELECT account_id, n, CAST(coalesce(CASE WHEN all_amt <> 0 THEN all_amt END, 1) AS DOUBLE) AS denom,
             'debit' AS side, d_total AS total, d_count AS count FROM g
      UNION ALL
      SELECT account_id, n, CAST(coalesce(CASE WHEN all_amt <> 0 THEN all_amt END, 1) AS DOUBLE) AS denom,
             'credit' AS side, c_total AS total, c_count AS count FROM g)"""


@register("debit_credit_analysis", with_txn("""
SELECT account_id, side, CAST(total AS DOUBLE) AS total, count, count / n * 100 AS pct_by_count,
       CAST(total AS DOUBLE) / denom * 100 AS pct_by_amount FROM s""", _DCA_G, _DCA_S))
def debit_credit_analysis(spark, sf_dir):
    """Per account and side: total, count, % by count, % by amount."""
    return A.debit_credit_analysis(txn(spark, sf_dir))


_MERCH = f"""
m AS (SELECT account_id, merchant, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount,
             count(amount) AS count, {AVG} AS avg_amount
      FROM txn WHERE merchant IS NOT NULL AND trim(merchant) <> '' GROUP BY account_id, merchant)"""


@register("merchant_analysis", with_txn("""
SELECT *, count(*) OVER (PARTITION BY account_id) AS total_unique_merchants FROM m""", _MERCH))
def merchant_analysis(spark, sf_dir):
    """Per account and merchant: total, count, mean; merchants per account."""
    return A.merchant_analysis(txn(spark, sf_dir))


@register("top_merchants", with_txn("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total_amount DESC, merchant ASC) AS rank FROM m)
WHERE rank <= 10""", _MERCH))
def top_merchants(spark, sf_dir):
    """Top 10 merchants by spend per account."""
    return A.top_merchants(txn(spark, sf_dir), 10)


@register("txn_type_distribution", with_txn("""
SELECT account_id, transaction_type, count, count / sum(count) OVER (PARTITION BY account_id) * 100 AS pct
FROM (SELECT account_id, transaction_type, count(*) AS count FROM txn
      WHERE transaction_type IS NOT NULL AND trim(transaction_type) <> '' GROUP BY 1, 2)"""))
def txn_type_distribution(spark, sf_dir):
    """Per account and type: count and share of non-blank types."""
    return A.txn_type_distribution(txn(spark, sf_dir))


_WEEK = ("strftime(date_trunc('week', date), '%Y-%m-%d') || '/' || "
         "strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d')")
_SERIES = f"""
wk AS (SELECT account_id, {_WEEK} AS week, sum(amount) AS total_debit FROM txn
       WHERE date IS NOT NULL AND {DEBIT} GROUP BY 1, 2),
mo AS (SELECT account_id, strftime(date, '%Y-%m') AS month, sum(amount) AS total_debit FROM txn
       WHERE date IS NOT NULL AND {DEBIT} GROUP BY 1, 2)"""


@register("weekly_spending", with_txn("SELECT account_id, week, CAST(total_debit AS DOUBLE) AS total_debit FROM wk", _SERIES))
def weekly_spending(spark, sf_dir):
    """Per account and Mon-Sun week: debit total."""
    return A.weekly_spending(txn(spark, sf_dir))


@register("monthly_spending", with_txn("SELECT account_id, month, CAST(total_debit AS DOUBLE) AS total_debit FROM mo", _SERIES))
def monthly_spending(spark, sf_dir):
    """Per account and month: debit total."""
    return A.monthly_spending(txn(spark, sf_dir))


def _chg(tab, per, out):
    return f"""
{out} AS (SELECT account_id, CASE WHEN n >= 2 AND prev <> 0 THEN CAST(last - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100 END AS {out}
  FROM (SELECT account_id, count(*) AS n,
               arg_max(total_debit, {per}) AS last,
               (SELECT arg_max(total_debit, {per}) FROM {tab} b WHERE b.account_id = a.account_id
                  AND b.{per} < (SELECT max({per}) FROM {tab} c WHERE c.account_id = a.account_id)) AS prev
        FROM {tab} a GROUP BY account_id))"""


_TRENDS_SQL = with_txn("""
SELECT k.account_id, w.wow_change_pct, m.mom_change_pct
FROM (SELECT DISTINCT account_id FROM txn) k LEFT JOIN wow w USING (account_id) LEFT JOIN mom m USING (account_id)""",
                       _SERIES, _chg("wk", "week", "wow"), _chg("mo", "month", "mom")).replace(
    "wow AS (SELECT account_id, CASE", "wow AS (SELECT account_id, CASE").replace(
    "END AS wow\n", "END AS wow_change_pct\n").replace("END AS mom\n", "END AS mom_change_pct\n")


@register("spending_trends", _TRENDS_SQL)
def spending_trends(spark, sf_dir):
    """Week-over-week and month-over-month debit change per account."""
    return A.spending_trends(txn(spark, sf_dir))


@register("monthly_projection", with_txn(f"""
SELECT account_id, '+' || CAST(k AS VARCHAR) || 'M' AS month, k AS step, net_flow,
       CAST(round(greatest(50000.0 + net_flow * k, 0.0)) AS BIGINT) AS balance,
       CASE WHEN 50000.0 + net_flow * 6 < 10000 THEN 'Critical' WHEN 50000.0 + net_flow * 6 < 30000 THEN 'High'
            WHEN 50000.0 + net_flow * 6 < 60000 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM (SELECT account_id, CAST(sum(c) AS DOUBLE) / count(*) - CAST(sum(d) AS DOUBLE) / count(*) AS net_flow
      FROM (SELECT account_id, strftime(date, '%Y-%m') AS month,
                   coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS d,
                   coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) AS c
            FROM txn WHERE date IS NOT NULL GROUP BY 1, 2) GROUP BY account_id),
     range(1, 7) r(k)"""))
def monthly_projection(spark, sf_dir):
    """Six-month balance projection from mean monthly net flow."""
    return A.monthly_projection(txn(spark, sf_dir))


@register("insights", with_txn(f"""
SELECT s.*, t.top_merchants, w.wow_change_pct, m.mom_change_pct
FROM (SELECT account_id,
       CAST(coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE) AS total_debit,
       CAST(coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) AS DOUBLE) AS total_credit,
       CAST(coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) - coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE) AS net_cash_flow,
       CAST(last(balance ORDER BY seq) FILTER (WHERE balance IS NOT NULL) AS DOUBLE) AS closing_balance,
       CASE WHEN max(date) IS NOT NULL THEN CAST(coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS DOUBLE)
            / greatest(date_diff('day', min(date), max(date)), 1) END AS average_daily_spending,
       CAST(max(CASE WHEN {DEBIT} THEN amount END) AS DOUBLE) AS largest_debit,
       CAST(max(CASE WHEN {CREDIT} THEN amount END) AS DOUBLE) AS largest_credit,
       {AVG} AS average_transaction, median(CAST(amount AS DOUBLE)) AS median_transaction
      FROM txn GROUP BY account_id) s
LEFT JOIN (SELECT account_id, string_agg(merchant, '|' ORDER BY rank) AS top_merchants FROM
           (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total_amount DESC, merchant ASC) AS rank FROM m)
           WHERE rank <= 10 GROUP BY account_id) t USING (account_id)
LEFT JOIN wow w USING (account_id) LEFT JOIN mom m2 USING (account_id)""",
    _MERCH, _SERIES, _chg("wk", "week", "wow"), _chg("mo", "month", "mom")).replace(
    "END AS wow\n", "END AS wow_change_pct\n").replace("END AS mom\n", "END AS mom_change_pct\n").replace(
    "m.mom_change_pct\nFROM", "m2.mom_change_pct\nFROM"))
def insights(spark, sf_dir):
    """Flattened insight record per account."""
    return A.insights(txn(spark, sf_dir))

"""Registered cash-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import cashflow as CF
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlparts import TXN_ORDERS_CTE, with_txn
from ledgerlens.sources.tables import txn, txn_orders

DEF = Config()
DEBIT = "trim(debit_credit) = 'Debit'"
CREDIT = "trim(debit_credit) = 'Credit'"


def _cf_ctes(src="txn"):
    return [f"""
ds AS (SELECT account_id, date, sum(amount) AS spend FROM {src}
       WHERE {DEBIT} AND amount IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2)""", """
dq AS (SELECT account_id, quantile_cont(CAST(spend AS DOUBLE), 0.95) AS trim_cut,
              quantile_cont(CAST(spend AS DOUBLE), 0.95) AS spike_thresh,
              median(CAST(spend AS DOUBLE)) AS median_daily_spending, count(*) AS active_debit_days,
              CAST(sum(spend) AS DOUBLE) / count(*) AS plain_mean FROM ds GROUP BY account_id)""", """
sp AS (SELECT q.account_id, q.trim_cut, q.spike_thresh, q.median_daily_spending, q.active_debit_days,
              coalesce(CAST(sum(CASE WHEN CAST(d.spend AS DOUBLE) <= q.trim_cut THEN d.spend END) AS DOUBLE)
                       / count(CASE WHEN CAST(d.spend AS DOUBLE) <= q.trim_cut THEN 1 END), q.plain_mean) AS estimated_daily_spending,
              count(CASE WHEN CAST(d.spend AS DOUBLE) > q.spike_thresh THEN 1 END) AS spike_days,
              first(d.date ORDER BY d.spend DESC, d.date ASC) FILTER (WHERE CAST(d.spend AS DOUBLE) > q.spike_thresh) AS worst_day,
              max(CASE WHEN CAST(d.spend AS DOUBLE) > q.spike_thresh THEN d.spend END) AS worst_spend
       FROM ds d JOIN dq q ON d.account_id = q.account_id
       GROUP BY q.account_id, q.trim_cut, q.spike_thresh, q.median_daily_spending, q.active_debit_days, q.plain_mean)""", f"""
m AS (SELECT b.account_id, b.statement_start, b.statement_end,
             greatest(date_diff('day', b.statement_start, b.statement_end) + 1, 1) AS calendar_days,
             t.total_debits, t.total_credits, t.n_debits, t.current_balance,
             coalesce(sp.active_debit_days, 0) AS active_debit_days,
             coalesce(sp.estimated_daily_spending, 0.0) AS estimated_daily_spending,
             coalesce(sp.median_daily_spending, 0.0) AS median_daily_spending,
             sp.spike_thresh, sp.spike_days, sp.worst_day, sp.worst_spend
      FROM (SELECT account_id, min(date) AS statement_start, max(date) AS statement_end FROM {src}
            WHERE date IS NOT NULL GROUP BY account_id) b
      LEFT JOIN (SELECT account_id,
                        coalesce(sum(CASE WHEN {DEBIT} THEN amount END), 0) AS total_debits,
                        coalesce(sum(CASE WHEN {CREDIT} THEN amount END), 0) AS total_credits,
                        count(CASE WHEN {DEBIT} AND amount IS NOT NULL THEN 1 END) AS n_debits,
                        coalesce(last(balance ORDER BY seq) FILTER (WHERE balance IS NOT NULL), 0) AS current_balance
                 FROM {src} GROUP BY account_id) t ON b.account_id = t.account_id
      LEFT JOIN sp ON b.account_id = sp.account_id)""", """
f AS (SELECT *, greatest(CAST(current_balance AS DOUBLE), 0.0) AS balance_pos,
             CASE WHEN estimated_daily_spending > 0
                  THEN CAST(floor(greatest(CAST(current_balance AS DOUBLE), 0.0) / estimated_daily_spending) AS INTEGER) END AS runway_days
      FROM m)""", f"""
fc AS (SELECT *, CASE WHEN runway_days IS NOT NULL THEN statement_end + runway_days END AS depletion_date,
              CASE WHEN runway_days IS NULL THEN 'UNKNOWN'
                   WHEN runway_days <= 7 OR balance_pos < {DEF.low_balance_abs * 0.25} THEN 'CRITICAL'
                   WHEN runway_days <= {DEF.low_runway_days} OR balance_pos < {DEF.low_balance_abs} THEN 'HIGH'
                   WHEN runway_days <= {DEF.low_runway_days * 3} THEN 'MEDIUM' ELSE 'LOW' END AS risk_classification
       FROM f)""", f"""
deb AS (SELECT * FROM {src} WHERE {DEBIT} AND amount IS NOT NULL)""", """
oq AS (SELECT account_id, count(*) AS n_debits, quantile_cont(CAST(amount AS DOUBLE), 0.99) AS outlier_thresh
       FROM deb GROUP BY account_id HAVING count(*) >= 20)""", """
ol AS (SELECT d.*, q.outlier_thresh,
              coalesce(CASE WHEN trim(narration) <> '' AND lower(trim(narration)) NOT IN ('nan', 'none') THEN trim(narration) END,
                       CASE WHEN trim(merchant) <> '' AND lower(trim(merchant)) NOT IN ('nan', 'none') THEN trim(merchant) END,
                       CASE WHEN trim(mode) <> '' AND lower(trim(mode)) NOT IN ('nan', 'none') THEN trim(mode) END) AS label
       FROM deb d JOIN oq q ON d.account_id = q.account_id)""", """
outl AS (SELECT account_id, outlier_thresh, count(CASE WHEN CAST(amount AS DOUBLE) > outlier_thresh THEN 1 END) AS outlier_count,
                CAST(max(CASE WHEN CAST(amount AS DOUBLE) > outlier_thresh THEN amount END) AS DOUBLE) AS largest_outlier,
                first(label ORDER BY amount DESC, seq ASC) FILTER (WHERE CAST(amount AS DOUBLE) > outlier_thresh) AS largest_label
         FROM ol GROUP BY account_id, outlier_thresh HAVING count(CASE WHEN CAST(amount AS DOUBLE) > outlier_thresh THEN 1 END) > 0)""", f"""
cr AS (SELECT * FROM {src} WHERE {CREDIT} AND amount IS NOT NULL AND date IS NOT NULL AND amount >= {DEF.recurring_income_min_amount})""", """
crh AS (SELECT account_id, count(narration) > 0 AS h_narration, count(merchant) > 0 AS h_merchant, count(mode) > 0 AS h_mode
        FROM cr GROUP BY account_id)""", f"""
rec AS (SELECT c.account_id,
               CASE WHEN h.h_narration THEN upper(trim(coalesce(c.narration, ''))) WHEN h.h_merchant THEN upper(trim(coalesce(c.merchant, '')))
                    WHEN h.h_mode THEN upper(trim(coalesce(c.mode, ''))) ELSE 'UNKNOWN' END AS income_key,
               count(DISTINCT strftime(c.date, '%Y-%m')) AS months
        FROM cr c JOIN crh h ON c.account_id = h.account_id GROUP BY 1, 2
        HAVING count(DISTINCT strftime(c.date, '%Y-%m')) >= {DEF.recurring_income_min_months})"""]


def q(body, src="txn"):
    extra = [TXN_ORDERS_CTE.strip()] if src == "txn_orders" else []
    return with_txn(body, *extra, *_cf_ctes(src))


@register("cf_metrics", q("""
SELECT account_id, calendar_days, active_debit_days, CAST(total_debits AS DOUBLE) AS total_debits,
       CAST(total_credits AS DOUBLE) AS total_credits, estimated_daily_spending, median_daily_spending,
       CAST(current_balance AS DOUBLE) AS current_balance, strftime(statement_start, '%Y-%m-%d') AS statement_start,
       strftime(statement_end, '%Y-%m-%d') AS statement_end FROM m"""))
def cf_metrics(spark, sf_dir):
    """Cash-flow base metrics per account (trimmed daily rate, balance, span)."""
    return CF.metrics(txn(spark, sf_dir), DEF).select(
        "account_id", "calendar_days", "active_debit_days", "total_debits", "total_credits",
        "estimated_daily_spending", "median_daily_spending", "current_balance", "statement_start", "statement_end")


@register("cf_runway", q("""
SELECT account_id, runway_days, strftime(depletion_date, '%Y-%m-%d') AS depletion_date, risk_classification FROM fc"""))
def cf_runway(spark, sf_dir):
    """Runway days, depletion date and risk class per account."""
    return CF.forecast(CF.metrics(txn(spark, sf_dir), DEF), DEF).select(
        "account_id", "runway_days", "depletion_date", "risk_classification")


@register("cf_projection", q(f"""
SELECT account_id, day, strftime(statement_end + CAST(day AS INTEGER), '%Y-%m-%d') AS date,
       greatest(greatest(CAST(current_balance AS DOUBLE), 0.0) - estimated_daily_spending * day, 0.0) AS projected_balance
FROM m, range(0, {DEF.forecast_horizon_days + 1}, 7) r(day)"""))
def cf_projection(spark, sf_dir):
    """Weekly projected balance over the 90-day horizon."""
    return CF.projection(CF.metrics(txn(spark, sf_dir), DEF), DEF)


@register("cf_spike_days", q("""
SELECT account_id, spike_thresh, spike_days, strftime(worst_day, '%Y-%m-%d') AS worst_day,
       CAST(worst_spend AS DOUBLE) AS worst_spend FROM m WHERE active_debit_days >= 10"""))
def cf_spike_days(spark, sf_dir):
    """Days above the 95th percentile of daily spend (accounts with >= 10 days)."""
    return CF.metrics(txn(spark, sf_dir), DEF).where(F.col("active_debit_days") >= 10).select(
        "account_id", "spike_thresh", "spike_days", "worst_day", "worst_spend")


@register("cf_outliers", q("SELECT account_id, outlier_thresh, outlier_count, largest_outlier, largest_label FROM outl"))
def cf_outliers(spark, sf_dir):
    """Debits above the 99th percentile (accounts with >= 20 debits)."""
    return CF.outliers(txn(spark, sf_dir), DEF)


@register("cf_recurring_income", q("SELECT account_id, income_key, months FROM rec", src="txn_orders"))
def cf_recurring_income(spark, sf_dir):
    """Credit keys of >= 1000 recurring in >= 3 distinct months (order history view)."""
    return CF.recurring_income(txn_orders(spark, sf_dir), DEF)


def _warn_sql():
    return f"""
SELECT fc.account_id,
  concat_ws('|',
    CASE WHEN balance_pos < {DEF.low_balance_abs} THEN 'Low balance: ' || format('{{:,.2f}}', balance_pos) || ' is below the {DEF.low_balance_abs:,.0f} threshold.' END,
    CASE WHEN runway_days IS NOT NULL AND runway_days < {DEF.low_runway_days} THEN 'Short runway: estimated ' || CAST(runway_days AS VARCHAR)
         || ' days of cash remaining at ' || format('{{:,.2f}}', estimated_daily_spending) || '/day spending rate.' END,
    CASE WHEN active_debit_days >= 10 AND spike_days > 0 THEN CAST(spike_days AS VARCHAR) || ' high-spend day(s) detected (above 95th percentile: '
         || format('{{:,.0f}}', spike_thresh) || '/day). Highest: ' || format('{{:,.2f}}', CAST(worst_spend AS DOUBLE)) || ' on '
         || strftime(worst_day, '%Y-%m-%d') || '.' END,
    CASE WHEN outlier_count > 0 THEN CAST(outlier_count AS VARCHAR) || ' unusually large debit(s) detected (above 99th percentile: '
         || format('{{:,.0f}}', outlier_thresh) || '). Largest: ' || format('{{:,.2f}}', largest_outlier)
         || coalesce(' (' || largest_label || ')', '') || '.' END,
    CASE WHEN r.k > 0 THEN 'Recurring income detected. Forecast may underestimate account longevity.' END) AS warnings,
  CAST(calendar_days >= 90 AS INTEGER)
  + coalesce(CAST(active_debit_days >= 10 AND spike_days / active_debit_days <= 0.08 AS INTEGER), 0)
  + CAST(n_debits >= 100 AS INTEGER)
  + coalesce(CAST(active_debit_days >= 10 AND active_debit_days > 0 AND spike_days / active_debit_days <= 0.05 AS INTEGER), 0) AS confidence_score
FROM fc LEFT JOIN outl o ON fc.account_id = o.account_id
LEFT JOIN (SELECT account_id, count(*) AS k FROM rec GROUP BY account_id) r ON fc.account_id = r.account_id"""


@register("cf_warnings", q(_warn_sql()))
def cf_warnings(spark, sf_dir):
    """The five warning texts and the 0-4 confidence points per account."""
    return CF.report(txn(spark, sf_dir), DEF).select("account_id", "warnings", "confidence_score")


@register("cf_warnings_orders", q(_warn_sql(), src="txn_orders"))
def cf_warnings_orders(spark, sf_dir):
    """Warnings and confidence on the long order history (recurring income fires)."""
    return CF.report(txn_orders(spark, sf_dir), DEF).select("account_id", "warnings", "confidence_score")


@register("cashflow", q(f"""
SELECT account_id, runway_days, risk_classification,
       CASE WHEN confidence_score >= 4 THEN 'High' WHEN confidence_score >= 2 THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM ({_warn_sql()}) w JOIN fc USING (account_id)""".replace("SELECT account_id, runway_days", "SELECT w.account_id, runway_days")))
def cashflow(spark, sf_dir):
    """Composite forecast per account: runway, risk class, confidence level."""
    return CF.report(txn(spark, sf_dir), DEF).select("account_id", "runway_days", "risk_classification", "confidence_level")

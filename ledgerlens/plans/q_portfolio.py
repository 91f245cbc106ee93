"""Registered portfolio-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import portfolio as P
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources.tables import txn

DEF = Config()
THR = 20000.0      # slider value used by the checked queries (hits at sf0.01)

_R0 = "'₹' || format('{:,.0f}', CAST({x} AS DOUBLE))"


def r0(x):
    return _R0.replace("{x}", x)


_PE = f"""
acct AS (SELECT account_id, avg(CAST(amount AS DOUBLE)) AS p_mean, stddev_samp(CAST(amount AS DOUBLE)) AS p_std,
                coalesce(sum(CASE WHEN upper(debit_credit) = 'DEBIT' THEN amount END), 0) AS p_debit,
                sum(amount) AS p_total FROM txn GROUP BY account_id),
amtc AS (SELECT account_id, amount, count(*) AS p_amount_n FROM txn WHERE amount IS NOT NULL GROUP BY 1, 2),
dayc AS (SELECT account_id, date, count(*) AS p_day_n FROM txn WHERE date IS NOT NULL GROUP BY 1, 2),
pe0 AS (SELECT t.*, a.p_mean, a.p_std, a.p_debit, a.p_total, c.p_amount_n, d.p_day_n,
               a.p_mean + 2 * a.p_std AS spike_thr,
               CAST(a.p_debit AS DOUBLE) / CAST(a.p_total AS DOUBLE) AS ratio
        FROM txn t JOIN acct a ON t.account_id = a.account_id
        LEFT JOIN amtc c ON t.account_id = c.account_id AND t.amount = c.amount
        LEFT JOIN dayc d ON t.account_id = d.account_id AND t.date = d.date),
pe1 AS (SELECT *, coalesce(amount > {THR}, false) AS p_high_value,
               coalesce(p_amount_n >= {DEF.portfolio_repeat_min}, false) AS p_repeated_amount,
               coalesce(p_std IS NOT NULL AND p_std > 0 AND amount > spike_thr, false) AS p_spike,
               coalesce(p_day_n > {DEF.portfolio_busy_day_min}, false) AS p_busy_day,
               coalesce(p_total > 0 AND ratio > {DEF.portfolio_excess_debit_ratio} AND upper(debit_credit) = 'DEBIT', false) AS p_excess_debit
        FROM pe0),
pe AS (SELECT *,
  concat_ws(' | ',
    CASE WHEN p_high_value THEN 'High-value transaction (' || {r0('amount')} || ' > threshold ₹{int(THR):,})' END,
    CASE WHEN p_repeated_amount THEN 'Repeated transaction amount (' || {r0('amount')} || ' appears ' || CAST(p_amount_n AS VARCHAR) || 'x)' END,
    CASE WHEN p_spike THEN 'Unusual spending spike (' || {r0('amount')} || ' exceeds mean+2σ = ' || {r0('spike_thr')} || ')' END,
    CASE WHEN p_busy_day THEN 'Multiple transactions on same day (' || CAST(p_day_n AS VARCHAR) || ' txns on ' || strftime(date, '%Y-%m-%d') || ')' END,
    CASE WHEN p_excess_debit THEN 'Excessive withdrawals — debits are ' || format('{{:.1f}}', ratio * 100) || '% of all transactions' END) AS reason,
  (CASE WHEN p_high_value THEN 30 ELSE 0 END) + (CASE WHEN p_repeated_amount THEN 20 ELSE 0 END)
  + (CASE WHEN p_spike THEN 25 ELSE 0 END) + (CASE WHEN p_busy_day THEN 15 ELSE 0 END)
  + (CASE WHEN p_excess_debit THEN 10 ELSE 0 END) AS raw_points
  FROM pe1)"""


def _ev(spark, sf_dir):
    return P.evaluate(txn(spark, sf_dir), DEF, THR)


for _name, _col in [("p_high_value", "p_high_value"), ("p_repeated_amount", "p_repeated_amount"),
                    ("p_spike", "p_spike"), ("p_busy_day", "p_busy_day"), ("p_excess_debit", "p_excess_debit")]:
    def _mk(col):
        def q(spark, sf_dir):
            return _ev(spark, sf_dir).where(F.col(col)).select("account_id", "seq", "amount")
        q.__doc__ = f"Rows flagged by portfolio rule {col}."
        return q
    register(_name, with_txn(f"SELECT account_id, seq, CAST(amount AS DOUBLE) AS amount FROM pe WHERE {_col}", _PE))(_mk(_col))


@register("p_flag_table", with_txn("""
SELECT account_id, seq AS txn_index, reason, least(raw_points, 100) AS risk_points, CAST(amount AS DOUBLE) AS amount,
       strftime(date, '%Y-%m-%d') AS date, merchant, transaction_type, debit_credit, CAST(balance AS DOUBLE) AS balance
FROM pe WHERE raw_points > 0""", _PE))
def p_flag_table(spark, sf_dir):
    """Flagged rows: reasons joined in rule order, points capped at 100."""
    return P.flag_table(txn(spark, sf_dir), DEF, THR)


@register("p_risk_score", with_txn("""
SELECT account_id, n, flagged,
       CASE WHEN flagged = 0 THEN 0.0 ELSE least(flagged / n * 60 + least(sev, 100.0) / 100 * 40, 100.0) END AS risk_score,
       CASE WHEN (CASE WHEN flagged = 0 THEN 0.0 ELSE least(flagged / n * 60 + least(sev, 100.0) / 100 * 40, 100.0) END) <= 30 THEN 'Low Risk'
            WHEN (CASE WHEN flagged = 0 THEN 0.0 ELSE least(flagged / n * 60 + least(sev, 100.0) / 100 * 40, 100.0) END) <= 60 THEN 'Medium Risk'
            ELSE 'High Risk' END AS risk_label
FROM (SELECT account_id, count(*) AS n, count(CASE WHEN raw_points > 0 THEN 1 END) AS flagged,
             avg(CASE WHEN raw_points > 0 THEN CAST(raw_points AS DOUBLE) END) AS sev FROM pe GROUP BY account_id)""", _PE))
def p_risk_score(spark, sf_dir):
    """Portfolio risk score and label per account."""
    return P.risk_score(txn(spark, sf_dir), DEF, THR)

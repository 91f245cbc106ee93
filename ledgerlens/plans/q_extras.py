"""Registered queries for the documented-only features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import extras as X
from ledgerlens.operators import scoring as S
from ledgerlens.plans.q_scoring import scored as _scored
from ledgerlens.plans.registry import REGISTRY, register
from ledgerlens.plans.sql_rules import RULE_COLS
from ledgerlens.plans.sql_scoring import scoring_ctes
from ledgerlens.plans.sqlparts import TXN_ORDERS_CTE, with_txn
from ledgerlens.sources.tables import txn, txn_orders

FIX = Config.fixture()


@register("reconcile_balance", with_txn("""
SELECT account_id, count(prev) AS checked,
       count(CASE WHEN prev IS NOT NULL AND balance <> prev + CASE WHEN debit_credit = 'Credit' THEN amount ELSE -amount END THEN 1 END) AS breaks
FROM (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY ts, seq) AS prev FROM txn) GROUP BY account_id"""))
def reconcile_balance(spark, sf_dir):
    """Balance continuity check per account (previous balance +/- amount)."""
    return X.reconcile_balance(txn(spark, sf_dir))


@register("dedupe_txn", with_txn("SELECT account_id, txn_id, seq FROM txn"))
def dedupe_txn(spark, sf_dir):
    """One row per transaction id (earliest in statement order)."""
    return X.dedupe_txn(txn(spark, sf_dir)).select("account_id", "txn_id", "seq")


@register("reconcile_balance_breaks", with_txn("""
SELECT account_id, count(prev) AS checked,
       count(CASE WHEN prev IS NOT NULL AND balance <> prev + CASE WHEN debit_credit = 'Credit' THEN amount ELSE -amount END THEN 1 END) AS breaks
FROM (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY ts, seq) AS prev FROM txn WHERE seq % 7 <> 3) GROUP BY account_id"""))
def reconcile_balance_breaks(spark, sf_dir):
    """Balance continuity of statements that lack every row with seq mod 7 = 3."""
    return X.reconcile_balance(txn(spark, sf_dir).where(F.col("seq") % 7 != 3))


@register("dedupe_txn_copies", with_txn("SELECT account_id, txn_id, seq FROM txn"))
def dedupe_txn_copies(spark, sf_dir):
    """Ids that come again: as the same row, and once more later in the statement."""
    t = txn(spark, sf_dir)
    later = t.where(F.col("seq") % 3 == 0).withColumn("seq", F.col("seq") + (1 << 40))
    return X.dedupe_txn(t.unionByName(t.where(F.col("seq") % 5 == 0)).unionByName(later)).select("account_id", "txn_id", "seq")


@register("structuring", with_txn("""
SELECT account_id, seq, near_count, CAST(near_total AS DOUBLE) AS near_total, window_count,
       near_count >= 3 AND near_total >= 10000.0 AS structuring, near_count / window_count AS confidence
FROM (SELECT account_id, seq, amount >= 9000.0 AND amount < 10000.0 AS near,
             count(CASE WHEN amount >= 9000.0 AND amount < 10000.0 THEN 1 END) OVER w AS near_count,
             coalesce(sum(CASE WHEN amount >= 9000.0 AND amount < 10000.0 THEN amount END) OVER w, 0) AS near_total,
             count(*) OVER w AS window_count
      FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
WHERE near"""))
def structuring(spark, sf_dir):
    """Near-threshold counts / sums over the preceding 6 days, flag and confidence."""
    return X.structuring(txn(spark, sf_dir))


@register("circadian", with_txn("""
SELECT account_id, seq, hour, hour_count, n, hour_count / n AS hour_share,
       CASE WHEN hour_count / n < 0.02 THEN 35 ELSE 0 END AS circadian_points
FROM (SELECT account_id, seq, hour(ts) AS hour, count(*) OVER (PARTITION BY account_id, hour(ts)) AS hour_count,
             count(*) OVER (PARTITION BY account_id) AS n FROM txn)"""))
def circadian(spark, sf_dir):
    """Hour-of-day rarity points per transaction."""
    return X.circadian(txn(spark, sf_dir))


@register("spending_profile", with_txn("""
SELECT account_id, mode, count(*) AS n, quantile_cont(CAST(amount AS DOUBLE), 0.1) AS p10,
       median(CAST(amount AS DOUBLE)) AS p50, quantile_cont(CAST(amount AS DOUBLE), 0.9) AS p90,
       (SELECT h FROM (SELECT hour(ts) AS h, count(*) AS c FROM txn t2 WHERE t2.account_id = t.account_id AND t2.mode = t.mode
                       GROUP BY 1) ORDER BY c DESC, h ASC LIMIT 1) AS usual_hour
FROM txn t GROUP BY account_id, mode"""))
def spending_profile(spark, sf_dir):
    """Per account x mode: amount percentiles and usual hour."""
    return X.spending_profile(txn(spark, sf_dir))


@register("profile_deviation", with_txn("""
SELECT t.account_id, seq, t.mode, CAST(amount AS DOUBLE) AS amount, p50,
       CASE WHEN p50 <> 0 THEN CAST(amount AS DOUBLE) / p50 END AS deviation_multiple
FROM txn t JOIN (SELECT account_id, mode, median(CAST(amount AS DOUBLE)) AS p50 FROM txn GROUP BY 1, 2) p
  ON t.account_id = p.account_id AND t.mode = p.mode"""))
def profile_deviation(spark, sf_dir):
    """Each transaction's amount as a multiple of the account's median in its mode."""
    return X.profile_deviation(txn(spark, sf_dir)).select("account_id", "seq", "mode", "amount", "p50", "deviation_multiple")


@register("stress_index", with_txn("""
SELECT account_id, atm_recent, atm_hist, ratio AS atm_ratio, share_r AS cash_share_recent, share_h AS cash_share_hist,
       50 * least(greatest(ratio - 1, 0.0), 1.0) + 50 * least(greatest(share_r - share_h, 0.0), 1.0) AS stress_index
FROM (SELECT *, atm_recent / greatest(atm_hist / greatest(date_diff('day', s, e) - 30 + 1, 1) * 30, 1.0) AS ratio,
             coalesce(cash_recent / all_recent, 0.0) AS share_r, coalesce(cash_hist / all_hist, 0.0) AS share_h
      FROM (SELECT t.account_id, max(e) AS e, max(s) AS s,
                   count(CASE WHEN date > e - 30 AND upper(mode) = 'ATM' THEN 1 END) AS atm_recent,
                   count(CASE WHEN NOT (date > e - 30) AND upper(mode) = 'ATM' THEN 1 END) AS atm_hist,
                   sum(CASE WHEN date > e - 30 AND upper(mode) = 'ATM' THEN CAST(amount AS DOUBLE) END) AS cash_recent,
                   sum(CASE WHEN date > e - 30 THEN CAST(amount AS DOUBLE) END) AS all_recent,
                   sum(CASE WHEN NOT (date > e - 30) AND upper(mode) = 'ATM' THEN CAST(amount AS DOUBLE) END) AS cash_hist,
                   sum(CASE WHEN NOT (date > e - 30) THEN CAST(amount AS DOUBLE) END) AS all_hist
            FROM txn_orders t JOIN (SELECT account_id, max(date) AS e, min(date) AS s FROM txn_orders GROUP BY 1) b
              ON t.account_id = b.account_id GROUP BY t.account_id))""".replace("upper(mode) = 'ATM'", "upper(mode) = '1-URGENT'"),
    TXN_ORDERS_CTE))
def stress_index(spark, sf_dir):
    """Recent-vs-history cash-usage stress index per account (order history
    view; '1-URGENT' priority stands in for the cash channel)."""
    d = txn_orders(spark, sf_dir).withColumn("mode", F.when(F.col("mode") == "1-URGENT", "ATM").otherwise(F.col("mode")))
    return X.stress_index(d)


@register("category_drop", with_txn("""
SELECT account_id, category, round(recent_amount, 6) AS recent_amount, round(norm_amount, 6) AS norm_amount,
       round(category_drop, 9) AS category_drop
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY round(category_drop, 9) DESC, category) AS n
      FROM (SELECT *, least(greatest(1.0 - recent_amount / norm_amount, 0.0), 1.0) AS category_drop
            FROM (SELECT t.account_id, merchant AS category,
                         coalesce(sum(CASE WHEN date > e - 30 THEN CAST(amount AS DOUBLE) END), 0.0) AS recent_amount,
                         coalesce(sum(CASE WHEN NOT date > e - 30 THEN CAST(amount AS DOUBLE) END), 0.0)
                           / greatest(date_diff('day', max(s), max(e)) - 30 + 1, 1) * 30 AS norm_amount
                  FROM txn_orders t JOIN (SELECT account_id, max(date) AS e, min(date) AS s FROM txn_orders GROUP BY 1) b
                    ON t.account_id = b.account_id
                  WHERE trim(debit_credit) = 'Debit' AND merchant IS NOT NULL GROUP BY 1, 2)
            WHERE norm_amount >= 1000))
WHERE n = 1""", TXN_ORDERS_CTE))
def category_drop(spark, sf_dir):
    """The category with the deepest drop below its norm, per account (order history)."""
    d = X.category_drop(txn_orders(spark, sf_dir))
    return d.select("account_id", "category", F.round("recent_amount", 6).alias("recent_amount"),
                    F.round("norm_amount", 6).alias("norm_amount"), F.round("category_drop", 9).alias("category_drop"))


@register("stress_with_category", f"""
SELECT s.account_id, round(atm_ratio, 6) AS atm_ratio, category, category_drop,
       round(least(stress_index + 25 * coalesce(category_drop, 0.0), 100.0), 6) AS stress_index
FROM ({REGISTRY["stress_index"].sql}) s LEFT JOIN ({REGISTRY["category_drop"].sql}) c ON s.account_id = c.account_id""")
def stress_with_category(spark, sf_dir):
    """Stress index with up to 25 points for the deepest category drop (order history)."""
    d = txn_orders(spark, sf_dir).withColumn("mode", F.when(F.col("mode") == "1-URGENT", "ATM").otherwise(F.col("mode")))
    return X.stress_with_category(d).select("account_id", F.round("atm_ratio", 6).alias("atm_ratio"), "category",
                                            F.round("category_drop", 9).alias("category_drop"),
                                            F.round("stress_index", 6).alias("stress_index"))


@register("recurring_bills", with_txn("""
SELECT account_id, merchant AS bill_key, dayofmonth(date) AS day_of_month, count(DISTINCT strftime(date, '%Y-%m')) AS months,
       CAST(sum(amount) AS DOUBLE) / count(*) AS mean_amount
FROM txn_orders WHERE trim(debit_credit) = 'Debit' AND date IS NOT NULL GROUP BY 1, 2, 3
HAVING count(DISTINCT strftime(date, '%Y-%m')) >= 3""", TXN_ORDERS_CTE))
def recurring_bills(spark, sf_dir):
    """Debits recurring on the same day of month in >= 3 months (order history)."""
    return X.recurring_bills(txn_orders(spark, sf_dir))


@register("daily_forecast", with_txn("""
SELECT s.account_id, s.day, strftime(s.end_date + CAST(s.day AS INTEGER), '%Y-%m-%d') AS date,
       coalesce(b.due, 0.0) AS bills_due,
       CAST(s.start_balance AS DOUBLE) - sum(coalesce(b.due, 0.0)) OVER (PARTITION BY s.account_id ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS projected_balance
FROM (SELECT account_id, last(balance ORDER BY ts, seq) AS start_balance, max(date) AS end_date FROM txn_orders GROUP BY 1) s0
     CROSS JOIN range(1, 31) r(day)
     JOIN LATERAL (SELECT s0.account_id, s0.start_balance, s0.end_date, r.day) s ON true
LEFT JOIN (SELECT st.account_id, st.day, sum(rb.mean_amount) AS due
           FROM (SELECT account_id, max(date) AS end_date FROM txn_orders GROUP BY 1) e CROSS JOIN range(1, 31) st0(day)
           JOIN LATERAL (SELECT e.account_id, st0.day, e.end_date + CAST(st0.day AS INTEGER) AS d) st ON true
           JOIN rb ON rb.account_id = st.account_id AND rb.day_of_month = dayofmonth(st.d)
           GROUP BY 1, 2) b ON b.account_id = s.account_id AND b.day = s.day""", TXN_ORDERS_CTE, """
rb AS (SELECT account_id, merchant AS bill_key, dayofmonth(date) AS day_of_month, CAST(sum(amount) AS DOUBLE) / count(*) AS mean_amount
       FROM txn_orders WHERE trim(debit_credit) = 'Debit' AND date IS NOT NULL GROUP BY 1, 2, 3
       HAVING count(DISTINCT strftime(date, '%Y-%m')) >= 3)"""))
def daily_forecast(spark, sf_dir):
    """30-day balance path with recurring bills subtracted on their days."""
    return X.daily_forecast(txn_orders(spark, sf_dir))


_FLAG = dict(zip(FIX.rule_names, RULE_COLS))


def _breakdown_sql():
    pts = FIX.points
    items = ", ".join(f"CASE WHEN {_FLAG[n]} THEN {{'f': '{n}', 'p': {pts[n]}}} END" for n in FIX.rule_names)
    return f"""
SELECT account_id, seq,
  concat_ws('|', list_aggregate(list_transform(
      list_sort(list_filter([{items}], lambda x: x IS NOT NULL), 'ASC', 'NULLS LAST'),
      lambda x, i: x.f || ':' || format('{{:,.2f}}', CAST(x.p AS DOUBLE) * CASE WHEN i = 1 THEN 1.0 WHEN i = 2 THEN 0.5 WHEN i = 3 THEN 0.25 ELSE 0.1 END * 3)),
    'string_agg', '|'), 'ML_BONUS:' || format('{{:,.2f}}', ml_score / 100.0 * 30.0)) AS breakdown
FROM scored"""


@register("score_breakdown")
def score_breakdown(spark, sf_dir):
    """Per-transaction contributions: each fired rule's weighted points and
    the ML bonus (rows-only check)."""
    return X.score_breakdown(_scored(spark, sf_dir, FIX), FIX)


@register("compare_accounts", with_txn("""
SELECT account_id, count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS total_amount,
       count(CASE WHEN final_risk_score >= 61.0 THEN 1 END) AS flagged, max(final_risk_score) AS max_score
FROM scored GROUP BY account_id""", *scoring_ctes(FIX)))
def compare_accounts(spark, sf_dir):
    """Multi-account comparison: volume, flagged count and max risk per account."""
    s = _scored(spark, sf_dir, FIX)
    return s.groupBy("account_id").agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").alias("total_amount"),
                                       F.count(F.when(F.col("final_risk_score") >= 61.0, 1)).alias("flagged"),
                                       F.max("final_risk_score").alias("max_score"))

"""Registered portfolio-report and episode queries."""

from __future__ import annotations

from functools import lru_cache

from ledgerlens.config import Config
from ledgerlens.operators import report as RP
from ledgerlens.operators import scoring as S
from ledgerlens.plans.q_scoring import scored as _scored
from ledgerlens.plans.registry import register
from ledgerlens.plans.sql_rules import RULE_COLS
from ledgerlens.plans.sql_scoring import scoring_ctes
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources.tables import txn

FIX = Config.fixture()
FL = "final_risk_score >= 61.0"


def scored(spark, sf_dir):
    """The persisted scored table (fixture thresholds)."""
    return _scored(spark, sf_dir, FIX)


def q(body, *ctes):
    return with_txn(body, *scoring_ctes(FIX), *ctes)


def _mode(col, where=FL):
    return (f"(SELECT {col} FROM scored s2 WHERE s2.account_id = s.account_id AND {where} "
            f"GROUP BY {col} ORDER BY count(*) DESC, {col} ASC LIMIT 1)")


@register("portfolio_summary", q(f"""
SELECT account_id, count(*) AS total_transactions, count(CASE WHEN {FL} THEN 1 END) AS flagged_count,
       CAST(coalesce(sum(CASE WHEN {FL} THEN amount END), 0) AS DOUBLE) AS total_amount_at_risk,
       avg(final_risk_score) AS avg_final_risk_score, max(final_risk_score) AS max_final_risk_score,
       count(CASE WHEN {FL} AND rule_flags = '' THEN 1 END) AS ml_only_caught,
       count(CASE WHEN {FL} AND rule_flags <> '' AND ml_score < 41.0 THEN 1 END) AS rules_only_caught,
       count(CASE WHEN {FL} AND rule_flags <> '' AND ml_score >= 41.0 THEN 1 END) AS both_caught,
       count(CASE WHEN {FL} THEN 1 END) / count(*) * 100.0 AS flag_rate_pct,
       coalesce({_mode('hour')}, -1) AS peak_fraud_hour,
       coalesce({_mode('dayname(date)')}, 'None') AS peak_fraud_day
FROM scored s GROUP BY account_id"""))
def portfolio_summary(spark, sf_dir):
    """Per account: totals, flagged count and rate, amount at risk, score
    stats, caught-by split, peak hour/day of flagged rows."""
    return RP.portfolio_summary(scored(spark, sf_dir), FIX)


_CATS = " UNION ALL ".join(f"SELECT '{c}' AS risk_category" for c in RP.CATEGORIES)


@register("risk_distribution", q(f"""
SELECT a.account_id, c.risk_category, coalesce(n.count, 0) AS count
FROM (SELECT DISTINCT account_id FROM scored) a CROSS JOIN ({_CATS}) c
LEFT JOIN (SELECT account_id, risk_category, count(*) AS count FROM scored GROUP BY 1, 2) n
  ON n.account_id = a.account_id AND n.risk_category = c.risk_category"""))
def risk_distribution(spark, sf_dir):
    """Counts over the six fixed risk categories per account, zeros included."""
    return RP.risk_distribution(scored(spark, sf_dir))


@register("fraud_type_breakdown", q(f"""
SELECT account_id, fraud_type_predicted, count(*) AS count FROM scored WHERE {FL} GROUP BY 1, 2"""))
def fraud_type_breakdown(spark, sf_dir):
    """Predicted fraud types among flagged rows per account."""
    return RP.fraud_type_breakdown(scored(spark, sf_dir), FIX)


_RULES = " UNION ALL ".join(
    f"SELECT account_id, '{n}' AS rule, count(CASE WHEN {c} THEN 1 END) AS count FROM scored GROUP BY account_id"
    for n, c in zip(FIX.rule_names, RULE_COLS))


@register("rule_trigger_counts", q(f"SELECT * FROM ({_RULES})"))
def rule_trigger_counts(spark, sf_dir):
    """How often each rule fired per account, zeros included."""
    return RP.rule_trigger_counts(scored(spark, sf_dir), FIX)


_SIG = " UNION ALL ".join(f"SELECT '{s}' AS dominant_signal" for s in RP.SIGNALS)


@register("dominant_signal_counts", q(f"""
SELECT a.account_id, g.dominant_signal, coalesce(n.count, 0) AS count
FROM (SELECT DISTINCT account_id FROM scored) a CROSS JOIN ({_SIG}) g
LEFT JOIN (SELECT account_id, dominant_signal, count(*) AS count FROM scored WHERE {FL} GROUP BY 1, 2) n
  ON n.account_id = a.account_id AND n.dominant_signal = g.dominant_signal"""))
def dominant_signal_counts(spark, sf_dir):
    """ML / RULES / BOTH among flagged rows per account."""
    return RP.dominant_signal_counts(scored(spark, sf_dir), FIX)


_EP = f"""
fl AS (SELECT * FROM scored WHERE {FL}),
ep0 AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq) IS NOT NULL
                        AND epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq)) > 86400000000
                       THEN 1 ELSE 0 END AS nw FROM fl),
ep AS (SELECT *, CAST(1 + sum(nw) OVER (PARTITION BY account_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS episode_id FROM ep0)"""

_FIRED = "concat_ws('|', " + ", ".join(
    f"CASE WHEN bool_or({c}) THEN '{n}' END" for n, c in sorted(zip(FIX.rule_names, RULE_COLS))) + ")"

_EPS = _EP + f""",
eg AS (SELECT account_id, episode_id, count(*) AS txn_count, sum(amount) AS total_amount,
              (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 AS duration_minutes,
              avg(final_risk_score) AS avg_final_score, max(final_risk_score) AS max_final_score,
              {_FIRED} AS rules_fired_in_episode,
              avg(ml_score) AS ml_avg_score, avg(CAST(rule_score AS DOUBLE)) AS rule_avg_score,
              avg(CAST(is_near_threshold = 1 AS DOUBLE)) AS near_share,
              max(CAST(balance_zeroed_out = 1 AS INTEGER)) AS zeroed_any,
              first(amount ORDER BY ts, seq) AS first_amount,
              count(CASE WHEN amount > 5000 THEN 1 END) AS n_big,
              avg(CAST(amount AS DOUBLE)) AS mean_amount
       FROM ep GROUP BY account_id, episode_id),
eps AS (SELECT *, txn_count > 1 AND first_amount < 500 AND n_big - CASE WHEN first_amount > 5000 THEN 1 ELSE 0 END > 0 AS card_testing,
              (SELECT fraud_type_predicted FROM ep e2 WHERE e2.account_id = eg.account_id AND e2.episode_id = eg.episode_id
               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_fraud_type
        FROM eg),
epf AS (SELECT account_id, episode_id, txn_count, CAST(total_amount AS DOUBLE) AS total_amount, duration_minutes,
               avg_final_score, max_final_score, dominant_fraud_type, rules_fired_in_episode, ml_avg_score,
               rule_avg_score, card_testing,
               CASE WHEN near_share > 0.50 THEN 'Smurfing'
                    WHEN zeroed_any = 1 AND duration_minutes < 30.0 THEN 'Account Draining'
                    WHEN txn_count > 5 AND duration_minutes < 20.0 THEN 'Coordinated Burst'
                    WHEN card_testing THEN 'Card Testing'
                    WHEN duration_minutes > 1440.0 AND mean_amount < 2000.0 THEN 'Slow Bleed'
                    WHEN contains(rules_fired_in_episode, 'LATE_NIGHT_TRANSACTION')
                         AND contains(rules_fired_in_episode, 'HIGH_VALUE_TRANSACTION') THEN 'Account Takeover'
                    ELSE 'Unknown Pattern' END AS attack_pattern
        FROM eps)"""


@register("episode_ids", q("""
SELECT account_id, seq, episode_id FROM ep""", _EP))
def episode_ids(spark, sf_dir):
    """Flagged rows sessionized into attack episodes (gap > 24 h splits)."""
    return RP.episode_ids(scored(spark, sf_dir), FIX).select("account_id", "seq", "episode_id")


@register("episodes", q("SELECT * FROM epf", _EPS))
def episodes(spark, sf_dir):
    """Per-episode summary with card testing and attack pattern."""
    return RP.episodes(scored(spark, sf_dir), FIX)


@register("top_episodes", q("""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY max_final_score DESC, episode_id ASC) AS rank FROM epf)
WHERE rank <= 3""", _EPS))
def top_episodes(spark, sf_dir):
    """Top 3 episodes per account by max final score."""
    return RP.top_episodes(RP.episodes(scored(spark, sf_dir), FIX), 3)


_FLAGGED_SQL = """strftime(date, '%Y-%m-%d') AS date, time, merchant, mode, CAST(amount AS DOUBLE) AS amount, debit_credit,
       rule_score, ml_score, final_risk_score, risk_category, dominant_signal, fraud_type_predicted,
       fraud_probability, rule_flags, rule_reasons, combined_reason"""


@register("top_flagged", q(f"""
SELECT account_id, seq, rank, {_FLAGGED_SQL} FROM
  (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY final_risk_score DESC, ts ASC, seq ASC) AS rank
   FROM scored WHERE {FL}) WHERE rank <= 10"""))
def top_flagged(spark, sf_dir):
    """Top 10 flagged transactions per account with evidence fields."""
    return RP.top_flagged(scored(spark, sf_dir), FIX, 10)


@register("flagged_records", q(f"""
SELECT account_id, seq AS transaction_index, {_FLAGGED_SQL} FROM scored WHERE {FL}"""))
def flagged_records(spark, sf_dir):
    """All flagged transactions as 17-field records."""
    return RP.flagged_records(scored(spark, sf_dir), FIX)


@register("narrative_payload")
def narrative_payload(spark, sf_dir):
    """Per-account JSON payload for a narrative report (rows-only check)."""
    return RP.narrative_payload(scored(spark, sf_dir), FIX)


@register("narrative_prompt")
def narrative_prompt(spark, sf_dir):
    """Per-account three-level prompt text (rows-only check)."""
    return RP.narrative_prompt(scored(spark, sf_dir), FIX)

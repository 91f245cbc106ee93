"""DuckDB oracle CTEs for the seven rules (brute force / RANGE frames; only
used as a correctness oracle on small fixtures)."""

from __future__ import annotations

import re

from ledgerlens.config import Config
from ledgerlens.plans.sqlparts import fmt2


def _s(x) -> str:
    return str(x)


def channel_sql() -> str:
    return ("CASE WHEN upper(trim(coalesce(mode, ''))) NOT IN ('', 'OTHERS') THEN upper(trim(mode)) "
            "WHEN regexp_extract(upper(trim(coalesce(narration, ''))), '^[^/\\s]*') <> '' "
            "THEN regexp_extract(upper(trim(coalesce(narration, ''))), '^[^/\\s]*') ELSE 'UNKNOWN' END")


def merchant_key_sql() -> str:
    nar = "trim(regexp_replace(upper(trim(coalesce(narration, ''))), '[/\\s_-]?\\d{4,}$', ''))"
    mo = "upper(trim(coalesce(mode, '')))"
    return (f"CASE WHEN trim(coalesce(merchant, '')) <> '' THEN upper(trim(merchant)) "
            f"WHEN {mo} <> '' AND {nar} <> '' THEN {mo} || '::' || {nar} "
            f"WHEN {mo} <> '' THEN {mo} WHEN {nar} <> '' THEN {nar} END")


def prep_cte(cfg: Config, src: str = "txn") -> str:
    kw = "|".join(re.escape(k) for k in cfg.withdrawal_keywords)
    return f"""
prep AS (
  SELECT *, {channel_sql()} AS channel, {merchant_key_sql()} AS merchant_key,
         coalesce(regexp_matches(lower(trim(coalesce(transaction_type, ''))) || ' ' ||
                                 lower(trim(coalesce(narration, ''))), '{kw}'), false) AS is_withdrawal,
         TRY_CAST(trim(split_part(trim(coalesce(time, '')), ':', 1)) AS INTEGER) AS time_hour
  FROM {src})"""


def rule_ctes(cfg: Config, src: str = "txn") -> list[str]:
    key = cfg.repeated_key
    w_us = int(cfg.repeated_window_hours * 3600 * 1_000_000)
    half_s = cfg.rapid_window_minutes * 60 / 2
    tol = cfg.repeated_tolerance
    pts = cfg.points
    flags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in zip(cfg.rule_names, RULE_COLS))
    reasons = ", ".join(f"CASE WHEN {c} THEN {REASONS[n](cfg)} END" for n, c in zip(cfg.rule_names, RULE_COLS))
    score = " + ".join(f"CASE WHEN {c} THEN {pts[n]} ELSE 0 END" for n, c in zip(cfg.rule_names, RULE_COLS))
    return [prep_cte(cfg, src), f"""
chmed AS (SELECT account_id, channel, median(CAST(amount AS DOUBLE)) AS channel_median
          FROM prep WHERE amount IS NOT NULL GROUP BY account_id, channel)""", """
day0 AS (SELECT account_id, date, coalesce(sum(amount), 0) AS day_total,
                count(CASE WHEN is_withdrawal THEN 1 END) AS day_withdrawals,
                first(balance ORDER BY ts, seq) FILTER (WHERE balance IS NOT NULL) AS day_opening
         FROM prep WHERE date IS NOT NULL GROUP BY account_id, date)""", f"""
dayf AS (SELECT *, coalesce(n_days >= {cfg.spike_min_days} AND day_total > {cfg.spike_multiplier} * median_day
                           AND day_total > {cfg.spike_floor}, false) AS spike_day
         FROM (SELECT *, count(*) OVER (PARTITION BY account_id) AS n_days,
                      median(CAST(day_total AS DOUBLE)) OVER (PARTITION BY account_id) AS median_day
               FROM day0))""", f"""
rapid AS (SELECT account_id, seq, count(*) OVER (PARTITION BY account_id ORDER BY ts
                 RANGE BETWEEN INTERVAL {half_s} SECONDS PRECEDING AND INTERVAL {half_s} SECONDS FOLLOWING) AS rapid_count
          FROM prep WHERE trim(coalesce(time, '')) <> '' AND ts IS NOT NULL)""", f"""
repc AS (SELECT * FROM prep WHERE ts IS NOT NULL AND amount IS NOT NULL AND {key} IS NOT NULL AND {key} <> ''),
rep AS (SELECT a.account_id, a.seq, count(*) AS repeat_partners
        FROM repc a JOIN repc b ON a.account_id = b.account_id AND a.{key} = b.{key} AND a.seq <> b.seq
         AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {w_us}
         AND CASE WHEN a.amount <> 0
                  THEN abs(CAST(a.amount AS DOUBLE) - CAST(b.amount AS DOUBLE)) / abs(CAST(a.amount AS DOUBLE)) <= {tol}
                  ELSE b.amount = 0 END
        GROUP BY a.account_id, a.seq)""", f"""
ev0 AS (SELECT p.*, m.channel_median, d.day_total, d.day_withdrawals, d.day_opening, d.n_days,
               d.median_day, d.spike_day, r.rapid_count, coalesce(q.repeat_partners, 0) AS repeat_partners
        FROM prep p LEFT JOIN chmed m ON p.account_id = m.account_id AND p.channel = m.channel
        LEFT JOIN dayf d ON p.account_id = d.account_id AND p.date = d.date
        LEFT JOIN rapid r ON p.account_id = r.account_id AND p.seq = r.seq
        LEFT JOIN rep q ON p.account_id = q.account_id AND p.seq = q.seq)""", f"""
ev AS (SELECT *,
  coalesce(amount IS NOT NULL AND channel_median <> 0 AND amount > {cfg.high_value_multiplier} * channel_median
           AND amount > {cfg.high_value_floor}, false) AS r_high_value,
  coalesce(spike_day, false) AS r_spending_spike,
  coalesce(repeat_partners >= {cfg.repeated_min_count - 1}, false) AS r_repeated,
  coalesce(is_withdrawal AND date IS NOT NULL AND day_withdrawals >= {cfg.withdrawal_threshold}, false) AS r_excess_withdrawal,
  coalesce(rapid_count >= {cfg.rapid_burst_threshold}, false) AS r_rapid,
  coalesce(amount >= {cfg.late_night_min_amount} AND (time_hour >= {cfg.late_night_start_hour}
           OR time_hour < {cfg.late_night_end_hour}), false) AS r_late_night,
  coalesce(amount IS NOT NULL AND balance IS NOT NULL AND day_opening > 0
           AND CAST(amount AS DOUBLE) / CAST(day_opening AS DOUBLE) > {cfg.balance_drop_pct}, false) AS r_balance_drop
  FROM ev0)""", f"""
scored_rules AS (SELECT *, concat_ws('|', {flags}) AS rule_flags, concat_ws('|', {reasons}) AS rule_reasons,
                        {score} AS rule_score FROM ev)"""]


RULE_COLS = ["r_high_value", "r_spending_spike", "r_repeated", "r_excess_withdrawal",
             "r_rapid", "r_late_night", "r_balance_drop"]


def _hv(cfg):
    return (f"'Amount ' || {fmt2('amount')} || ' exceeds {cfg.high_value_multiplier}x ' || channel || "
            f"' channel median (' || {fmt2('channel_median')} || ') and absolute floor ({cfg.high_value_floor:,.0f})'")


def _spike(cfg):
    return (f"'Daily spend ' || {fmt2('day_total')} || ' on ' || strftime(date, '%Y-%m-%d') || "
            f"' exceeded {cfg.spike_multiplier}× median daily spend (' || {fmt2('median_day')} || "
            f"') and floor ({cfg.spike_floor:,.0f})'")


def _rep(cfg):
    return (f"'Key ''' || {cfg.repeated_key} || ''' with amount ~' || {fmt2('amount')} || ' repeated ' || "
            f"CAST(repeat_partners + 1 AS VARCHAR) || 'x within {cfg.repeated_window_hours}h "
            f"(+/- {cfg.repeated_tolerance * 100:.0f}% tolerance)'")


def _wd(cfg):
    return (f"CAST(day_withdrawals AS VARCHAR) || ' withdrawals on ' || strftime(date, '%Y-%m-%d') || "
            f"' (threshold: {cfg.withdrawal_threshold})'")


def _rapid(cfg):
    return (f"CAST(rapid_count AS VARCHAR) || ' transactions within {cfg.rapid_window_minutes}-minute window "
            f"(threshold: {cfg.rapid_burst_threshold})'")


def _late(cfg):
    return (f"'Transaction of ' || {fmt2('amount')} || ' at ' || trim(coalesce(time, '')) || "
            f"' falls in late-night window ({cfg.late_night_start_hour}:00-{cfg.late_night_end_hour}:00), "
            f"min amount {cfg.late_night_min_amount:,.0f}'")


def _drop(cfg):
    return (f"'Transaction of ' || {fmt2('amount')} || ' is ' || "
            f"format('{{:.1f}}', CAST(amount AS DOUBLE) / CAST(day_opening AS DOUBLE) * 100) || "
            f"'% of opening balance ' || {fmt2('day_opening')} || ' on ' || strftime(date, '%Y-%m-%d') || "
            f"' (threshold: {cfg.balance_drop_pct * 100:.0f}%)'")


REASONS = {
    "HIGH_VALUE_TRANSACTION": _hv, "SPENDING_SPIKE": _spike, "REPEATED_TRANSACTION": _rep,
    "EXCESSIVE_WITHDRAWAL": _wd, "RAPID_TRANSACTION": _rapid, "LATE_NIGHT_TRANSACTION": _late,
    "BALANCE_DROP_ALERT": _drop,
}

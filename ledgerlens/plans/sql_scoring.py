"""DuckDB oracle CTEs for features, the no-model ML score and G4 fusion."""

from __future__ import annotations

from ledgerlens.config import Config
from ledgerlens.operators.scoring import DIMINISHING, OVERRIDES
from ledgerlens.plans.sql_rules import RULE_COLS, rule_ctes

_FLAG_COL = dict(zip(Config().rule_names, RULE_COLS))


def scoring_ctes(cfg: Config) -> list[str]:
    pts = cfg.points
    plist = ", ".join(f"CASE WHEN {_FLAG_COL[n]} THEN {pts[n]} END" for n in cfg.rule_names)
    fac = " ".join(f"WHEN i = {k + 1} THEN CAST({f} AS DOUBLE)" for k, f in enumerate(DIMINISHING[:-1]))
    conds = []
    for names, fl in OVERRIDES:
        conds.append((" AND ".join(_FLAG_COL[n] for n in names), fl, " + ".join(names)))
    hit = " OR ".join(f"({c})" for c, _, _ in conds)
    floor = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {fl} ELSE 0.0 END" for c, fl, _ in conds) + ")"
    label = "CASE " + " ".join(f"WHEN {c} THEN '{lab}'" for c, _, lab in reversed(conds)) + " END"
    return [*rule_ctes(cfg), """
agg AS (SELECT account_id, quantile_cont(CAST(amount AS DOUBLE), 0.95) AS amount_p95,
               avg(CAST(amount AS DOUBLE)) AS amount_mean, stddev_pop(CAST(amount AS DOUBLE)) AS amount_std_pop
        FROM txn GROUP BY account_id)""", """
feat0 AS (SELECT s.*, a.amount_p95, a.amount_mean, a.amount_std_pop,
                 coalesce(CAST(s.amount AS DOUBLE), 0.0) AS amount_f,
                 coalesce(CAST(s.balance AS DOUBLE), 0.0) AS balance_after,
                 coalesce(hour(s.ts), 12) AS hour, coalesce(isodow(s.ts) - 1, 0) AS day_of_week,
                 coalesce(month(s.ts), 1) AS month,
                 (epoch_us(s.ts) - epoch_us(lag(s.ts) OVER (PARTITION BY s.account_id ORDER BY s.ts, s.seq))) / 1e6 AS gap_s
          FROM scored_rules s JOIN agg a ON s.account_id = a.account_id)""", """
feat1 AS (SELECT *, CASE WHEN upper(trim(debit_credit)) IN ('CREDIT', 'CR', 'C') THEN balance_after - amount_f
                         ELSE balance_after + amount_f END AS balance_before FROM feat0)""", """
feat AS (SELECT *,
   CAST(day_of_week >= 5 AS INTEGER) AS is_weekend, ln(1 + amount_f) AS log_amount,
   CAST(hour >= 23 OR hour <= 5 AS INTEGER) AS is_night,
   CAST(hour >= 0 AND hour <= 6 AS INTEGER) AS is_early_morning,
   CAST(amount_f % 1000 = 0 AS INTEGER) AS is_round_amount,
   CAST(amount_f >= 9000 AND amount_f <= 9999 AS INTEGER) AS is_near_threshold,
   CAST(coalesce(amount_f > amount_p95, false) AS INTEGER) AS is_large_amount,
   CAST(balance_after <= 0 AS INTEGER) AS balance_zeroed_out,
   least(CASE WHEN balance_before + 1 <> 0 THEN amount_f / (balance_before + 1)
              WHEN amount_f > 0 THEN 10.0 WHEN amount_f < 0 THEN -'inf'::DOUBLE ELSE 0.0 END, 10.0) AS amount_to_balance_ratio,
   balance_before - balance_after AS balance_delta
 FROM feat1)""", """
ml0 AS (SELECT *,
   CAST(least(greatest(is_large_amount * 0.25 + is_night * 0.20 + balance_zeroed_out * 0.25
                  + is_near_threshold * 0.20 + is_round_amount * 0.10, 0.0), 1.0) AS DOUBLE) AS xgb_prob,
   CAST(CASE WHEN coalesce(gap_s, 3600.0) < 60 THEN 1.0 WHEN coalesce(gap_s, 3600.0) < 300 THEN 0.7
        WHEN coalesce(gap_s, 3600.0) < 900 THEN 0.4 WHEN coalesce(gap_s, 3600.0) < 3600 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS score_velocity,
   least(greatest((least(greatest(abs((amount_f - amount_mean) / (coalesce(amount_std_pop, 0.0) + 1e-9)) / 5.0, 0.0), 1.0)
                   + 0.0) / 2.0, 0.0), 1.0) AS score_spending_dev
 FROM feat)""", f"""
ml AS (SELECT *, 0.0 * 0.60 AS score_iso_component, xgb_prob * 15.0 AS score_xgb_component,
              xgb_prob * 5.0 AS score_rf_component, score_velocity * 10.0 AS velocity_component,
              score_spending_dev * 10.0 AS spending_dev_component,
              least(greatest(0.0 * 0.60 + xgb_prob * 15.0 + xgb_prob * 5.0 + score_velocity * 10.0
                             + score_spending_dev * 10.0, 0.0), 100.0) AS ml_score
       FROM ml0)""", f"""
fused0 AS (SELECT *, ml_score / 100.0 AS fraud_probability,
   CASE WHEN ml_score < {cfg.fraud_type_threshold} THEN 'Normal'
        WHEN is_near_threshold = 1 THEN 'Smurfing / Structuring'
        WHEN is_early_morning = 1 AND is_large_amount = 1 THEN 'Account Takeover'
        WHEN balance_zeroed_out = 1 THEN 'Account Draining'
        WHEN amount_to_balance_ratio > 2 THEN 'Overdraft Fraud'
        WHEN is_large_amount = 1 AND is_round_amount = 1 THEN 'Money Laundering'
        WHEN is_night = 1 THEN 'Unauthorized Access' ELSE 'General Fraud' END AS fraud_type_predicted,
   least(coalesce(list_sum(list_transform(list_reverse_sort(list_filter([{plist}], lambda x: x IS NOT NULL)),
          lambda x, i: CAST(x AS DOUBLE) * CASE {fac} ELSE CAST({DIMINISHING[-1]} AS DOUBLE) END)), 0.0) * 3, 70.0) AS rule_boost_applied,
   ml_score / 100.0 * 30.0 AS ml_bonus,
   ({hit}) AS hard_override_applied, {floor} AS override_floor, {label} AS override_rule
 FROM ml)""", f"""
fused AS (SELECT *, least(greatest(CASE WHEN hard_override_applied THEN greatest(rule_boost_applied + ml_bonus, override_floor)
                                  ELSE rule_boost_applied + ml_bonus END, 0.0), 100.0) AS final_risk_score,
                 'RULES' AS dominant_signal FROM fused0)""", f"""
scored AS (SELECT *,
   CASE WHEN final_risk_score <= 20 THEN 'Very Low' WHEN final_risk_score <= 40 THEN 'Low'
        WHEN final_risk_score <= 60 THEN 'Medium' WHEN final_risk_score <= 80 THEN 'High'
        WHEN final_risk_score <= 95 THEN 'Very High' ELSE 'Critical' END AS risk_category,
   'Rule-based flags: ' || CASE WHEN rule_reasons = '' THEN 'no rule flags' ELSE replace(rule_reasons, '|', '; ') END
     || '. ML score below threshold (' || format('{{:.0f}}', ml_score) || '/100)' AS combined_reason,
   CAST(final_risk_score >= {cfg.flag_threshold} AS INTEGER) AS is_fraud_predicted
 FROM fused)"""]

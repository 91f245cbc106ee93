"""Registered earlier-generation scoring queries (G2 / G3 variants)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import scoring as S
from ledgerlens.operators import variants as V
from ledgerlens.plans.q_scoring import scored as _scored
from ledgerlens.plans.registry import register
from ledgerlens.plans.sql_rules import RULE_COLS
from ledgerlens.plans.sql_scoring import scoring_ctes
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources.tables import txn

FIX = Config.fixture()
DEF = Config()
_FLAG = dict(zip(FIX.rule_names, RULE_COLS))


def _cal(x):
    return f"least(greatest(0.7 * (100.0 / (1.0 + exp(-0.12 * (({x}) - 50.0)))) + 0.3 * ({x}), 0.0), 100.0)"


def _g3_ctes(cfg):
    pts = cfg.points
    plist = ", ".join(f"CASE WHEN {_FLAG[n]} THEN {pts[n]} END" for n in cfg.rule_names)
    fac = "CASE WHEN i = 1 THEN 1.0 WHEN i = 2 THEN 0.6 WHEN i = 3 THEN 0.3 ELSE 0.1 END"
    conds = [(" AND ".join(_FLAG[n] for n in names), fl, " + ".join(names)) for names, fl in S.OVERRIDES]
    hit = " OR ".join(f"({c})" for c, _, _ in conds)
    floor = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {fl} ELSE 0.0 END" for c, fl, _ in conds) + ")"
    label = "CASE " + " ".join(f"WHEN {c} THEN '{lab}'" for c, _, lab in reversed(conds)) + " END"
    w = [round(x * 100, 9) for x in cfg.ml_weights_g3]
    return [*scoring_ctes(cfg), f"""
g3a AS (SELECT *, xgb_prob * {w[0]} AS g3_xgb_component, xgb_prob * (1.0 - abs(xgb_prob - xgb_prob)) * {w[1]} AS g3_rf_component,
               score_velocity * {w[2]} AS g3_velocity_component, score_spending_dev * {w[3]} AS g3_spending_component,
               least(greatest(CAST(is_night * 0.40 + is_early_morning * 0.25 + is_round_amount * 0.15 + is_near_threshold * 0.20 AS DOUBLE), 0.0), 1.0) * {w[4]} AS g3_time_component
        FROM scored)""", f"""
g3b AS (SELECT *, {_cal('g3_xgb_component + g3_rf_component + g3_velocity_component + g3_spending_component + g3_time_component')} AS g3_ml_score,
               coalesce(list_sum(list_transform(list_reverse_sort(list_filter([{plist}], lambda x: x IS NOT NULL)),
                        lambda x, i: CAST(x AS DOUBLE) * {fac})), 0.0) * {cfg.fusion_boost_weight} / 85.0 * 15.0 AS boost0,
               rule_flags <> '' AND NOT contains(rule_flags, '|') AS single_flag
        FROM g3a)""", f"""
g3c AS (SELECT *, single_flag AND g3_ml_score < 15.0 AND rule_flags IN ('LATE_NIGHT_TRANSACTION', 'SPENDING_SPIKE') AS sup_strong,
               single_flag AND NOT (g3_ml_score < 15.0 AND rule_flags IN ('LATE_NIGHT_TRANSACTION', 'SPENDING_SPIKE')) AND g3_ml_score < 20.0 AS sup_weak
        FROM g3b)""", f"""
g3 AS (SELECT *, CASE WHEN sup_strong THEN boost0 * 0.2 WHEN sup_weak THEN boost0 * 0.4 ELSE boost0 END AS g3_rule_boost,
              sup_strong OR sup_weak AS g3_suppression_applied, ({hit}) AS g3_hard_override_applied,
              {floor} AS g3_floor, {label} AS g3_override_rule FROM g3c)"""]


@register("score_g3", with_txn(f"""
SELECT account_id, seq, g3_ml_score, g3_rule_boost, g3_suppression_applied, g3_hard_override_applied, g3_override_rule,
       CASE WHEN g3_rule_boost > 8.0 AND g3_ml_score < 50.0 THEN 'RULES' WHEN g3_ml_score > 60.0 AND g3_rule_boost < 5.0 THEN 'ML'
            ELSE 'BOTH' END AS g3_dominant_signal,
       {_cal('CASE WHEN g3_hard_override_applied THEN greatest(g3_ml_score + g3_rule_boost, g3_floor) ELSE g3_ml_score + g3_rule_boost END')} AS g3_final_score
FROM g3""", *_g3_ctes(FIX)))
def score_g3(spark, sf_dir):
    """G3 'ML base + rule boost' scoring (fallback probabilities as model
    scores): calibrated base, diminishing boost, suppression, overrides."""
    s = _scored(spark, sf_dir, FIX)
    g = V.fuse_g3(V.score_ml_g3(s, FIX), FIX)
    return g.select("account_id", "seq", "g3_ml_score", "g3_rule_boost", "g3_suppression_applied",
                    "g3_hard_override_applied", "g3_override_rule", "g3_dominant_signal", "g3_final_score")


@register("evidence_pack")
def evidence_pack(spark, sf_dir):
    """Nested ML / rule / fusion evidence per transaction as JSON (rows-only)."""
    s = _scored(spark, sf_dir, FIX)
    g = V.fuse_g3(V.score_ml_g3(s, FIX), FIX)
    return g.select("account_id", "seq", V.evidence_pack(g).alias("evidence"))


_FB = """
fb AS (SELECT t.account_id, t.seq,
              least(greatest(((CASE WHEN CAST(t.amount AS DOUBLE) > q.p95 THEN 1.0 ELSE 0.0 END) * 25
                              + (CASE WHEN CAST(t.amount AS DOUBLE) % 1000 = 0 THEN 1.0 ELSE 0.0 END) * 10
                              + (CASE WHEN hour(t.ts) >= 23 OR hour(t.ts) <= 5 THEN 1.0 ELSE 0.0 END) * 20) / 100, 0.0), 1.0) AS fallback_probability
       FROM txn t JOIN (SELECT account_id, quantile_cont(CAST(amount AS DOUBLE), 0.95) AS p95 FROM txn GROUP BY account_id) q
         ON t.account_id = q.account_id)"""
_CUT = "CASE WHEN {p} <= 0.30 THEN 'LOW' WHEN {p} <= 0.60 THEN 'MEDIUM' WHEN {p} <= 0.80 THEN 'HIGH' ELSE 'CRITICAL' END"


@register("rule_fallback_g2", with_txn(f"""
SELECT account_id, seq, fallback_probability, CAST(fallback_probability > 0.5 AS INTEGER) AS fallback_is_fraud,
       {_CUT.format(p='fallback_probability')} AS fallback_risk_level,
       'Rule-based: ' || {_CUT.format(p='fallback_probability')} AS fallback_reason FROM fb""", _FB))
def rule_fallback_g2(spark, sf_dir):
    """G2 rule fallback probability, level and reason when no model loads."""
    d = V.rule_fallback_g2(txn(spark, sf_dir))
    return d.select("account_id", "seq", "fallback_probability", "fallback_is_fraud", "fallback_risk_level", "fallback_reason")


_REASONS_SQL = ("concat_ws(' | ', " + ", ".join(
    f"CASE WHEN {c} THEN '{t}' END" for c, t in [
        ("is_night = 1", "Night-time transaction"), ("is_early_morning = 1", "Early morning (12–6 AM)"),
        ("is_large_amount = 1", "Amount in top 5% of all transactions"),
        ("balance_zeroed_out = 1", "Account balance drained to zero"),
        ("amount_to_balance_ratio > 0.8", "Uses >80% of account balance"),
        ("is_round_amount = 1", "Suspiciously round amount"),
        ("is_near_threshold = 1", "Amount just below ₹10,000 (smurfing)"),
        ("amount_to_balance_ratio > 2", "Amount exceeds available balance")]) + ")")


@register("score_g2", with_txn(f"""
SELECT account_id, seq, p AS g2_probability, CAST(p > 0.5 AS INTEGER) AS g2_is_fraud_predicted,
       {_CUT.format(p='p')} AS g2_risk_level,
       CASE WHEN p < 0.30 THEN 'No significant fraud signals' WHEN r = '' THEN 'Multiple weak anomaly signals combined' ELSE r END AS g2_fraud_reason
FROM (SELECT s.account_id, s.seq, (0.45 * s.xgb_prob + 0.4 * fb.fallback_probability) / 0.85 AS p, {_REASONS_SQL} AS r
      FROM scored s JOIN fb ON s.account_id = fb.account_id AND s.seq = fb.seq)""", *scoring_ctes(DEF), _FB))
def score_g2(spark, sf_dir):
    """G2 ensemble (xgb slot = fallback probability, rf slot = G2 rule
    fallback), right-closed risk bins, reason phrases."""
    s = _scored(spark, sf_dir, DEF)
    fb = V.rule_fallback_g2(txn(spark, sf_dir)).select("account_id", "seq", "fallback_probability")
    g = V.score_g2(s.join(fb, ["account_id", "seq"]), {"xgb": "xgb_prob", "rf": "fallback_probability"})
    return g.select("account_id", "seq", "g2_probability", "g2_is_fraud_predicted", "g2_risk_level", "g2_fraud_reason")

"""Earlier scoring generations kept selectable:

* ``g2``: weighted ensemble .45 / .40 / .15 of available model scores,
  right-closed risk bins, reason phrases, and a rule fallback;
* ``g3``: ML base score 55 xgb + 15 rf x agreement + 15 velocity + 10
  spending + 5 time context, calibrated; fusion = ML base + diminishing rule
  boost with single-flag suppression, overrides and a final calibration.
All are column arithmetic on the scored rows (no extra shuffles except the
per-account p95 of the fallback, a grouped aggregate joined back).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions.quantiles import grouped_quantiles, join_groups
from ledgerlens.operators.scoring import G3_BOOST_FACTORS, OVERRIDES, _diminishing, points_of

ACC = ("account_id",)
# fixed values: ensemble weights of the second generation
G2_WEIGHTS = (("xgb", 0.45), ("rf", 0.40), ("iso", 0.15))


def ensemble_g2(scores: dict[str, Column]) -> Column:
    """Weighted mean of the model scores that exist (weights renormalised)."""
    w = dict(G2_WEIGHTS)
    num = sum((F.lit(w.get(k, 0.33)) * v for k, v in scores.items()), F.lit(0.0))
    den = sum(w.get(k, 0.33) for k in scores)
    return num / F.lit(den)


def risk_cut_g2(p: Column) -> Column:
    return (F.when(p <= 0.30, "LOW").when(p <= 0.60, "MEDIUM").when(p <= 0.80, "HIGH").otherwise("CRITICAL"))


# fixed values: G2 reason phrases in order
G2_REASONS = (
    ("is_night", "Night-time transaction"),
    ("is_early_morning", "Early morning (12–6 AM)"),
    ("is_large_amount", "Amount in top 5% of all transactions"),
    ("balance_zeroed_out", "Account balance drained to zero"),
    ("__util", "Uses >80% of account balance"),
    ("is_round_amount", "Suspiciously round amount"),
    ("is_near_threshold", "Amount just below ₹10,000 (smurfing)"),
    ("__over", "Amount exceeds available balance"),
)


def reasons_g2(p: Column) -> Column:
    conds = {"__util": F.col("balance_utilization") > 0.8, "__over": F.col("amount_to_balance_ratio") > 2}
    parts = [F.when(conds[c] if c in conds else (F.col(c) == 1), F.lit(t)) for c, t in G2_REASONS]
    joined = F.array_join(F.array_compact(F.array(*parts)), " | ")
    return (F.when(p < 0.30, "No significant fraud signals")
            .when(joined == "", "Multiple weak anomaly signals combined").otherwise(joined))


def score_g2(d: DataFrame, scores: dict[str, str]) -> DataFrame:
    p = ensemble_g2({k: F.col(v) for k, v in scores.items()})
    d = d.withColumn("g2_probability", p)
    return d.withColumns({
        "g2_is_fraud_predicted": (F.col("g2_probability") > 0.50).cast("int"),
        "g2_risk_level": risk_cut_g2(F.col("g2_probability")),
        "g2_fraud_reason": reasons_g2(F.col("g2_probability")),
    })


def rule_fallback_g2(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """25 x (amount > group p95) + 10 x round + 20 x night, / 100."""
    a = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    d = df.withColumn("__a", a)
    d = join_groups(d, grouped_quantiles(d, by, F.col("__a"), {"__p95": 0.95}), by)
    h = F.hour("ts")
    s = ((F.col("__a") > F.col("__p95")).cast("double") * 25 + (F.col("__a") % 1000 == 0).cast("double") * 10
         + F.coalesce(((h >= 23) | (h <= 5)).cast("double"), F.lit(0.0)) * 20)
    d = d.withColumn("fallback_probability", C.clip(s / 100, 0.0, 1.0))
    lvl = risk_cut_g2(F.col("fallback_probability"))
    return d.withColumns({"fallback_is_fraud": (F.col("fallback_probability") > 0.5).cast("int"),
                          "fallback_risk_level": lvl,
                          "fallback_reason": F.concat(F.lit("Rule-based: "), lvl)}).drop("__a", "__p95")


def time_context() -> Column:
    s = (F.col("is_night") * 0.40 + F.col("is_early_morning") * 0.25 + F.col("is_round_amount") * 0.15
         + F.col("is_near_threshold") * 0.20)
    return C.clip(s.cast("double"), 0.0, 1.0)


def score_ml_g3(d: DataFrame, cfg: Config = Config(), rules_only: bool = False) -> DataFrame:
    if rules_only:
        return d.withColumns({"g3_ml_score": F.lit(50.0), "g3_xgb_component": F.lit(27.5),
                              "g3_rf_component": F.lit(7.5), "g3_velocity_component": F.lit(7.5),
                              "g3_spending_component": F.lit(5.0), "g3_time_component": F.lit(2.5)})
    w = cfg.ml_weights_g3
    agreement = 1.0 - F.abs(F.col("xgb_prob") - F.col("rf_prob"))
    pts = [round(x * 100, 9) for x in w]
    d = d.withColumns({
        "g3_xgb_component": F.col("xgb_prob") * pts[0],
        "g3_rf_component": F.col("rf_prob") * agreement * pts[1],
        "g3_velocity_component": F.col("score_velocity") * pts[2],
        "g3_spending_component": F.col("score_spending_dev") * pts[3],
        "g3_time_component": time_context() * pts[4],
    })
    raw = (F.col("g3_xgb_component") + F.col("g3_rf_component") + F.col("g3_velocity_component")
           + F.col("g3_spending_component") + F.col("g3_time_component"))
    return d.withColumn("g3_ml_score", C.calibrate(raw, cfg.calibration_k, cfg.calibration_stretch_weight,
                                                   cfg.calibration_raw_weight))


def fuse_g3(d: DataFrame, cfg: Config = Config(), rules_only: bool = False) -> DataFrame:
    flags = F.col("rule_flags")
    ml = F.col("g3_ml_score")
    boost = _diminishing(points_of(flags, cfg), G3_BOOST_FACTORS) * cfg.fusion_boost_weight / 85.0 * 15.0
    single = F.size(flags) == 1
    first = F.try_element_at(flags, F.lit(1))
    sup_strong = single & (ml < 15.0) & first.isin("LATE_NIGHT_TRANSACTION", "SPENDING_SPIKE")
    sup_weak = single & ~sup_strong & (ml < 20.0)
    boost = F.when(sup_strong, boost * 0.2).when(sup_weak, boost * 0.4).otherwise(boost)
    d = d.withColumns({"g3_rule_boost": boost, "g3_suppression_applied": sup_strong | sup_weak})
    floor, hit = F.lit(0.0), F.lit(False)
    label = F.lit(None).cast("string")
    for names, fl in OVERRIDES:
        cond = F.lit(True)
        for n in names:
            cond = cond & F.array_contains(flags, n)
        floor = F.when(cond, F.greatest(floor, F.lit(fl))).otherwise(floor)
        label = F.when(cond, F.lit(" + ".join(names))).otherwise(label)
        hit = hit | cond
    raw = ml + F.col("g3_rule_boost")
    raw = F.when(hit, F.greatest(raw, floor)).otherwise(raw)
    dom = (F.lit("RULES") if rules_only else
           F.when((F.col("g3_rule_boost") > 8.0) & (ml < 50.0), "RULES")
           .when((ml > 60.0) & (F.col("g3_rule_boost") < 5.0), "ML").otherwise("BOTH"))
    return d.withColumns({
        "g3_hard_override_applied": hit, "g3_override_rule": label, "g3_dominant_signal": dom,
        "g3_final_score": C.calibrate(raw, cfg.calibration_k, cfg.calibration_stretch_weight, cfg.calibration_raw_weight),
    })


def evidence_pack(d: DataFrame) -> Column:
    """Nested ML / rule / fusion evidence as JSON text."""
    return F.to_json(F.struct(
        F.struct(F.col("g3_xgb_component").alias("xgb_score"), F.col("g3_rf_component").alias("rf_score"),
                 F.col("g3_velocity_component").alias("velocity_score"),
                 F.col("g3_spending_component").alias("spending_dev_score"),
                 F.col("g3_time_component").alias("time_context_score"), F.col("g3_ml_score").alias("ml_base_score"),
                 F.col("fraud_type_predicted").alias("fraud_type"),
                 (F.col("g3_ml_score") / 100).alias("fraud_probability")).alias("ml_evidence"),
        F.struct(F.col("rule_flags").alias("flags_fired"), F.col("rule_reasons").alias("reasons"),
                 F.col("rule_score").alias("rule_points_raw"), F.col("g3_rule_boost").alias("rule_boost_applied")).alias("rule_evidence"),
        F.struct(F.col("g3_ml_score").alias("ml_base_score"), F.col("g3_rule_boost").alias("rule_boost"),
                 F.col("g3_hard_override_applied").alias("hard_override_applied"),
                 F.col("g3_override_rule").alias("override_rule"),
                 F.col("g3_suppression_applied").alias("suppression_applied"),
                 F.col("g3_final_score").alias("final_score"),
                 F.col("g3_dominant_signal").alias("dominant_signal")).alias("fusion_metadata")))

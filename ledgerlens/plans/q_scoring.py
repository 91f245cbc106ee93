"""Registered feature / ML-score / fusion queries and the flagship."""

from __future__ import annotations

from ledgerlens.config import Config
from ledgerlens.operators import features as FE
from ledgerlens.operators import scoring as S
from ledgerlens.plans.registry import register
from ledgerlens.plans.sql_scoring import scoring_ctes
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources.tables import txn

DEF = Config()
FIX = Config.fixture()

FLAGSHIP_COLS = ["account_id", "seq", "rule_score", "rule_flags", "ml_score", "score_xgb_component",
                 "score_velocity", "score_spending_dev", "fraud_type_predicted", "fraud_probability",
                 "final_risk_score", "risk_category", "rule_boost_applied", "hard_override_applied",
                 "override_rule", "dominant_signal", "combined_reason", "is_fraud_predicted"]


def scored(spark, sf_dir, cfg=DEF):
    """The scored transaction table for ``cfg``: computed once per input and
    code version, persisted as a stage table, read by every consumer."""
    from ledgerlens.session import materialized
    from ledgerlens.sources.tables import _src
    return materialized(spark, "scored", _src(sf_dir, "events"),
                        lambda: S.score_transactions(txn(spark, sf_dir, cfg), cfg), key_extra=repr(cfg))


@register("score_transactions", with_txn(f"SELECT {', '.join(FLAGSHIP_COLS)} FROM scored", *scoring_ctes(DEF)))
def score_transactions(spark, sf_dir):
    """Flagship: features -> 7 rules -> ML score -> fusion -> category and reasons."""
    return scored(spark, sf_dir, DEF).select(*FLAGSHIP_COLS)


@register("score_transactions_fixture", with_txn(f"SELECT {', '.join(FLAGSHIP_COLS)} FROM scored", *scoring_ctes(FIX)))
def score_transactions_fixture(spark, sf_dir):
    """Flagship under fixture thresholds (burst and repeat rules fire, overrides hit)."""
    return scored(spark, sf_dir, FIX).select(*FLAGSHIP_COLS)


FEATURE_OUT = ["account_id", "seq", "amount_f", "log_amount", "hour", "day_of_week", "is_weekend", "month",
               "is_night", "is_early_morning", "is_round_amount", "is_near_threshold", "is_large_amount",
               "balance_before", "balance_after", "balance_delta", "balance_zeroed_out",
               "amount_to_balance_ratio"]


@register("engineer_features", with_txn(f"SELECT {', '.join(FEATURE_OUT)}, amount_to_balance_ratio AS balance_utilization FROM feat",
                                        *scoring_ctes(DEF)))
def engineer_features(spark, sf_dir):
    """The numeric model features (crc32 encodings excluded: no SQL twin)."""
    return FE.engineer_features(txn(spark, sf_dir)).select(*FEATURE_OUT, "balance_utilization")


@register("feat_encode")
def feat_encode(spark, sf_dir):
    """crc32 % 7 encodings of merchant, mode and transaction type (rows-only check)."""
    return FE.engineer_features(txn(spark, sf_dir)).select(
        "account_id", "seq", "merchant_encoded", "channel_encoded", "txn_type_encoded")


ML_OUT = ["account_id", "seq", "xgb_prob", "score_velocity", "score_spending_dev", "score_xgb_component",
          "score_rf_component", "velocity_component", "spending_dev_component", "ml_score",
          "fraud_probability", "fraud_type_predicted"]


@register("score_ml", with_txn(f"SELECT {', '.join(ML_OUT)} FROM fused0", *scoring_ctes(DEF)))
def score_ml(spark, sf_dir):
    """ML score without trained models: fallback probability, velocity, deviation."""
    return scored(spark, sf_dir, DEF).select(*ML_OUT)


FUSE_OUT = ["account_id", "seq", "rule_boost_applied", "ml_bonus", "hard_override_applied", "override_rule",
            "final_risk_score", "risk_category", "is_fraud_predicted"]


@register("fuse", with_txn(f"SELECT {', '.join(FUSE_OUT)} FROM scored", *scoring_ctes(FIX)))
def fuse(spark, sf_dir):
    """Rules-base + ML-bonus fusion with override floors (fixture thresholds)."""
    return scored(spark, sf_dir, FIX).select(*FUSE_OUT)

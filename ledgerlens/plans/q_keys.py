"""Inventory keys that are parts of larger registered plans, registered as
projections of their parent query (same Spark plan, same oracle SQL with the
matching column subset) so each key is checked on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import scoring as S
from ledgerlens.operators import textlines as TL
from ledgerlens.plans.q_scoring import scored as _scored
from ledgerlens.plans.registry import REGISTRY, register
from ledgerlens.plans.sql_scoring import scoring_ctes
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources import statements as SS
from ledgerlens.sources.tables import txn

DEF = Config()


def project(name: str, parent: str, cols: list[str], doc: str) -> None:
    par = REGISTRY[parent]
    sql = f"SELECT {', '.join(cols)} FROM ({par.sql}) q" if par.sql else None

    def fn(spark, sf_dir):
        return par.build(spark, sf_dir).select(*cols)
    fn.__doc__ = doc
    register(name, sql)(fn)


ACC = ["account_id", "seq"]
PAIRS = [
    ("feat_columns", "engineer_features", ACC + ["amount_f", "balance_after"], "Resolved money columns with defaults."),
    ("feat_calendar", "engineer_features", ACC + ["hour", "day_of_week", "is_weekend", "month"], "Calendar features."),
    ("feat_log_amount", "engineer_features", ACC + ["log_amount"], "ln(1 + amount)."),
    ("feat_night", "engineer_features", ACC + ["is_night", "is_early_morning"], "Night (>=23 or <=5) and early (0-6) flags."),
    ("feat_round", "engineer_features", ACC + ["is_round_amount", "is_near_threshold"], "Round and near-threshold amounts."),
    ("feat_large", "engineer_features", ACC + ["is_large_amount"], "Amount above the account's 95th percentile."),
    ("feat_balance", "engineer_features", ACC + ["balance_before", "balance_delta", "balance_zeroed_out",
                                                 "amount_to_balance_ratio", "balance_utilization"], "Balance features."),
    ("score_rule_fallback_prob", "score_ml", ACC + ["xgb_prob"], "No-model probability from the fixed rule mix."),
    ("score_velocity", "score_ml", ACC + ["score_velocity"], "Velocity score from the gap to the previous txn."),
    ("score_spending_dev", "score_ml", ACC + ["score_spending_dev"], "Spending deviation score (population sigma)."),
    ("risk_category", "score_transactions_fixture", ACC + ["final_risk_score", "risk_category"], "Six risk bands."),
    ("combined_reason", "score_transactions_fixture", ACC + ["dominant_signal", "combined_reason"], "Explanation text."),
    ("predicted_flag", "score_transactions_fixture", ACC + ["is_fraud_predicted"], "final >= 61."),
    ("fuse_override", "fuse", ACC + ["hard_override_applied", "override_rule", "final_risk_score"], "Override floors."),
    ("fuse_dominant", "score_transactions_fixture", ACC + ["dominant_signal"], "Dominant signal of the fusion."),
    ("fuse_g3", "score_g3", ACC + ["g3_rule_boost", "g3_suppression_applied", "g3_final_score"], "ML-base + boost fusion."),
    ("score_ml_g3", "score_g3", ACC + ["g3_ml_score"], "Calibrated five-component ML score."),
    ("ensemble_g2", "score_g2", ACC + ["g2_probability"], "Weighted ensemble of available scores."),
    ("risk_cut_g2", "score_g2", ACC + ["g2_risk_level", "g2_is_fraud_predicted"], "Right-closed risk bins."),
    ("reasons_g2", "score_g2", ACC + ["g2_fraud_reason"], "Ordered reason phrases."),
    ("rule_reasons", "rule_engine_fixture", ACC + ["rule_reasons"], "Formatted reason per fired rule."),
    ("rule_levels", "rule_flagged", ACC + ["rule_score", "risk_level"], "CRITICAL / HIGH / MODERATE / LOW."),
    ("total_debit", "kpis", ["account_id", "total_debit"], "Sum of debits (0 when none)."),
    ("total_credit", "kpis", ["account_id", "total_credit"], "Sum of credits (0 when none)."),
    ("transaction_count", "kpis", ["account_id", "transaction_count"], "Rows per account."),
    ("average_transaction", "kpis", ["account_id", "average_transaction"], "Mean amount."),
    ("median_transaction", "kpis", ["account_id", "median_transaction"], "Exact median amount."),
    ("get_summary_g1", "summary_g1", ["account_id", "total_amount", "avg_amount", "max_amount", "min_amount",
                                      "debit_total", "credit_total", "top_type", "top_merchant"], "Statement-demo summary."),
    ("p_risk_label", "p_risk_score", ["account_id", "risk_label"], "Low / Medium / High portfolio label."),
    ("peak_fraud_hour", "portfolio_summary", ["account_id", "peak_fraud_hour"], "Modal hour of flagged rows (-1 when none)."),
    ("peak_fraud_day", "portfolio_summary", ["account_id", "peak_fraud_day"], "Modal weekday of flagged rows ('None')."),
    ("caught_stats", "portfolio_summary", ["account_id", "ml_only_caught", "rules_only_caught", "both_caught"], "Caught-by split."),
    ("card_testing", "episodes", ["account_id", "episode_id", "card_testing"], "Small first then large later."),
    ("attack_pattern", "episodes", ["account_id", "episode_id", "attack_pattern"], "Ordered episode pattern."),
    ("cf_trimmed_rate", "cf_metrics", ["account_id", "estimated_daily_spending"], "Mean of daily debits <= p95."),
    ("cf_risk", "cf_runway", ["account_id", "risk_classification"], "Runway risk class."),
    ("cf_confidence", "cf_warnings", ["account_id", "confidence_score"], "Four-point forecast confidence."),
    ("txt_date_asof", "txt_parse_layout", ["doc_id", "first_line", "date"], "As-of date label by y on the page."),
    ("txt_amount_from_balance", "txt_parse_layout", ["doc_id", "first_line", "debit_credit", "amount", "balance"],
     "Amount and side from the balance delta."),
    ("txt_type_layout", "txt_parse_layout", ["doc_id", "first_line", "transaction_type"], "Keyword type classification."),
    ("txt_merchant_layout", "txt_parse_layout", ["doc_id", "first_line", "merchant"], "Merchant by type-specific rule."),
    ("txt_time", "txt_parse_layout", ["doc_id", "first_line", "time"], "First HH:MM:SS in the description."),
    ("txt_drcr", "txt_parse_dated", ["doc_id", "first_line", "debit_credit"], "CR / DR from the merchant text."),
    ("txt_type_prefix", "txt_parse_dated", ["doc_id", "first_line", "transaction_type"], "Type by prefix."),
    ("txt_clean_narration", "txt_parse_context", ["doc_id", "line_no", "narration"], "Narration cleanup."),
    ("txt_parse_dates", "txt_merge_debit_credit", ["doc_id", "row_no", "date"], "Day-first date parsing."),
    ("txt_dedupe", "txn_dedupe", ["doc_id", "first_line"], "First row per (doc, amount, balance)."),
    ("std_debit_credit", "std_layout_c", ACC + ["debit_credit"], "Dr/Cr labels normalised."),
    ("std_amount", "std_layout_c", ACC + ["amount"], "'$1,234.50' money text to number."),
    ("std_text", "std_layout_c", ACC + ["merchant"], "Trimmed text, blank to null."),
    ("std_date", "std_layout_c", ACC + ["date"], "Multi-format date parsing."),
    ("std_time", "std_layout_c", ACC + ["time"], "Time text normalised to HH:MM:SS."),
    ("std_datetime_split", "standardize", ACC + ["date", "time"], "Date and wall-clock time from an ISO-offset column."),
    ("map_columns", "std_layout_generic", ACC + ["debit_credit", "amount", "merchant"], "Header synonyms (unmatched -> null)."),
]
for _n, _p, _c, _d in PAIRS:
    project(_n, _p, _c, _d)


@register("fraud_type_heuristic", with_txn("""
SELECT account_id, seq, CASE WHEN ml_score * 2.5 < 41 THEN 'Normal'
        WHEN is_near_threshold = 1 THEN 'Smurfing / Structuring'
        WHEN is_early_morning = 1 AND is_large_amount = 1 THEN 'Account Takeover'
        WHEN balance_zeroed_out = 1 THEN 'Account Draining'
        WHEN amount_to_balance_ratio > 2 THEN 'Overdraft Fraud'
        WHEN is_large_amount = 1 AND is_round_amount = 1 THEN 'Money Laundering'
        WHEN is_night = 1 THEN 'Unauthorized Access' ELSE 'General Fraud' END AS fraud_type
FROM ml""", *scoring_ctes(DEF)))
def fraud_type_heuristic(spark, sf_dir):
    """Heuristic fraud type applied to a 0-100 score (2.5 x the no-model ML score)."""
    s = _scored(spark, sf_dir, DEF)
    return s.select("account_id", "seq", S.fraud_type_heuristic(F.col("ml_score") * 2.5, DEF).alias("fraud_type"))


@register("score_time_context", with_txn("""
SELECT account_id, seq, least(greatest(CAST(is_night * 0.40 + is_early_morning * 0.25 + is_round_amount * 0.15
                                        + is_near_threshold * 0.20 AS DOUBLE), 0.0), 1.0) AS time_context
FROM feat""", *scoring_ctes(DEF)))
def score_time_context(spark, sf_dir):
    """Time-context component (.40 night + .25 early + .15 round + .20 near)."""
    from ledgerlens.operators import features as FE
    from ledgerlens.operators.variants import time_context
    return FE.engineer_features(txn(spark, sf_dir)).select("account_id", "seq", time_context().alias("time_context"))


@register("txt_group_layout", with_txn("""
SELECT account_id AS doc_id, count(*) + 1 AS transactions FROM txn GROUP BY account_id"""))
def txt_group_layout(spark, sf_dir):
    """Description lines grouped into transactions (incl. BALANCE FORWARD) per document."""
    from ledgerlens.plans.q_text import lines_table
    lay = lines_table(spark, sf_dir, "layout")
    desc = lay.where(F.col("desc_text").isNotNull()).select("doc_id", "line_no", F.col("desc_text").alias("text"))
    return TL._blocks(desc, TL.TXN_START, True, "\n").groupBy("doc_id").agg(F.count(F.lit(1)).alias("transactions"))


@register("src_statement_lines", with_txn("""
SELECT account_id AS doc_id, count(*) + count(CASE WHEN seq % 3 = 0 THEN 1 END) + 1 AS lines FROM txn GROUP BY account_id"""))
def src_statement_lines(spark, sf_dir):
    """Statement-lines table (doc, line_no, text) rendered from the transactions."""
    from ledgerlens.plans.q_text import lines_table
    return lines_table(spark, sf_dir, "dated").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


def _models(spark, sf_dir, *names):
    from ledgerlens.plans.q_ml import fitted
    return fitted(spark, sf_dir, names)


def _metrics(spark, sf_dir, *names):
    from ledgerlens.plans.q_ml import metrics
    return metrics(spark, sf_dir, names)


@register("train_rf")
def train_rf(spark, sf_dir):
    """Random forest (200 trees, depth 12, leaf >= 5, class weights): test metrics."""
    return _metrics(spark, sf_dir, "rf", "iso").where(F.col("model") == "random_forest")


@register("train_gbt")
def train_gbt(spark, sf_dir):
    """Boosted trees (300 x depth 6, lr .05, .8 row / feature share) + isotonic calibration: test metrics."""
    return _metrics(spark, sf_dir, "gbt", "iso").where(F.col("model") == "gbt_calibrated")


@register("train_iforest")
def train_iforest(spark, sf_dir):
    """Isolation forest node table: nodes and depth per tree (rows-only)."""
    m = _models(spark, sf_dir, "iso")
    return m.iso_nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"))


@register("score_iforest")
def score_iforest(spark, sf_dir):
    """0-100 isolation score of every transaction (higher = more anomalous)."""
    from ledgerlens.operators import features as FE
    m = _models(spark, sf_dir, "iso")
    f = FE.engineer_features(txn(spark, sf_dir))
    return m.iso.score(m.iso.raw(f)).select("account_id", "seq", "iso_score")


@register("balance_classes")
def balance_classes(spark, sf_dir):
    """Class weights n / (2 n_class) on the training split (rows-only)."""
    from ledgerlens.operators import ml as ML
    from ledgerlens.plans.q_ml import labelled
    tr, _ = ML.stratified_split(labelled(spark, sf_dir))
    return ML.with_class_weights(tr).groupBy(ML.LABEL, "weight").agg(F.count(F.lit(1)).alias("rows"))


@register("scale_features")
def scale_features(spark, sf_dir):
    """z-scored model features: per-feature mean and std after scaling (rows-only)."""
    from pyspark.ml.functions import vector_to_array
    from ledgerlens.operators import features as FE
    from ledgerlens.operators import ml as ML
    from ledgerlens.plans.q_ml import prepared
    f = FE.engineer_features(txn(spark, sf_dir))
    v = ML.scaler(prepared(spark, sf_dir)[0]).transform(f).select(vector_to_array("features").alias("f"))
    return v.select(F.posexplode("f").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


@register("model_store")
def model_store(spark, sf_dir):
    """Models saved and loaded back; which parts exist (rows-only)."""
    from ledgerlens.operators import ml as ML
    from ledgerlens.session import checkpoint_dir
    import uuid
    m = _models(spark, sf_dir, "gbt", "rf", "iso")
    path = f"{checkpoint_dir(spark)}/ledgerlens-models-{uuid.uuid4().hex[:8]}"
    m.save(path)
    back = ML.FraudModels.load(spark, path)
    parts = [("random_forest", back.rf is not None), ("gbt", back.gbt is not None),
             ("calibrator", back.calibrator is not None), ("isolation_forest", back.iso_nodes is not None)]
    return spark.createDataFrame(parts, "part string, present boolean")

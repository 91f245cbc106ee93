"""Registered model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.operators import features as FE
from ledgerlens.operators import ml as ML
from ledgerlens.operators import scoring as S
from ledgerlens.plans.q_scoring import scored as _scored
from ledgerlens.plans.registry import register
from ledgerlens.plans.sql_scoring import scoring_ctes
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.session import checkpoint_dir
from ledgerlens.sources.statements import planted_fraud
from ledgerlens.sources.tables import txn

DEF = Config()
PLANTED = "CASE WHEN amount > 20000 OR ((seq * 7919) % 1000) < 20 THEN 1 ELSE 0 END"
_MODELS = {}


def labelled(spark, sf_dir):
    """Engineered features + the planted label (training frame)."""
    return FE.engineer_features(txn(spark, sf_dir)).withColumn(ML.LABEL, planted_fraud())


def _once(spark, sf_dir, name, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)     # belongs to one running context
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def prepared(spark, sf_dir):
    """(training part, test part), stored once."""
    return _once(spark, sf_dir, "parts", lambda: ML.prepare(labelled(spark, sf_dir)))


def fitted(spark, sf_dir, names=("gbt", "rf", "iso")):
    """The models of ``names``, each fitted once, those still missing side by side."""
    from concurrent.futures import ThreadPoolExecutor
    train = prepared(spark, sf_dir)[0]
    fit = {"gbt": ML.train_gbt, "rf": ML.train_rf, "iso": ML.fit_isolation}
    with ThreadPoolExecutor(len(fit)) as pool:      # only submits Spark jobs
        made = {n: pool.submit(_once, spark, sf_dir, n, lambda n=n: fit[n](train)) for n in names}
        got = {n: f.result() for n, f in made.items()}
    gbt, calibrator = got.get("gbt", (None, None))
    return ML.FraudModels(rf=got.get("rf"), gbt=gbt, calibrator=calibrator, iso=got.get("iso"))


def metrics(spark, sf_dir, names=("gbt", "rf", "iso")):
    return ML.evaluate(fitted(spark, sf_dir, names), prepared(spark, sf_dir)[1])


@register("class_distribution", with_txn(f"""
SELECT is_fraud, count(*) AS count, count(*) / sum(count(*)) OVER () * 100 AS pct
FROM (SELECT {PLANTED} AS is_fraud FROM txn) GROUP BY is_fraud"""))
def class_distribution(spark, sf_dir):
    """Label counts and shares of the training frame."""
    return ML.class_distribution(labelled(spark, sf_dir))


@register("stratified_split", with_txn(f"""
SELECT 'test' AS split, is_fraud, greatest(CAST(round(n * 0.2) AS BIGINT), CASE WHEN n > 1 THEN 1 ELSE 0 END) AS count
FROM (SELECT {PLANTED} AS is_fraud, count(*) AS n FROM txn GROUP BY 1)
UNION ALL
SELECT 'train', is_fraud, n - greatest(CAST(round(n * 0.2) AS BIGINT), CASE WHEN n > 1 THEN 1 ELSE 0 END)
FROM (SELECT {PLANTED} AS is_fraud, count(*) AS n FROM txn GROUP BY 1)"""))
def stratified_split(spark, sf_dir):
    """Rows per (split, class) of the stratified 80/20 split."""
    train, test = ML.stratified_split(labelled(spark, sf_dir))
    count = lambda d, name: (d.groupBy(ML.LABEL).agg(F.count(F.lit(1)).alias("count"))
                             .select(F.lit(name).alias("split"), ML.LABEL, "count"))
    return count(train, "train").unionByName(count(test, "test"))


@register("eval_binary", with_txn(f"""
SELECT tp, fp, fn, tn, roc_auc, avg_precision, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
      FROM (SELECT count(CASE WHEN s > 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN s > 0.5 AND y = 0 THEN 1 END) AS fp,
                   count(CASE WHEN s <= 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN s <= 0.5 AND y = 0 THEN 1 END) AS tn
            FROM sy) c,
           (SELECT sum(p * (n_le - n + 0.5 * n)) / (max(pp) * max(nn)) AS roc_auc,
                   sum(CASE WHEN p > 0 THEN p / pp * tp_ge / all_ge ELSE 0.0 END) AS avg_precision
            FROM (SELECT *, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_le,
                         sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
                         sum(p + n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_ge,
                         sum(p) OVER () AS pp, sum(n) OVER () AS nn
                  FROM (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM sy GROUP BY s))) a)""",
    *scoring_ctes(DEF), f"sy AS (SELECT xgb_prob AS s, {PLANTED} AS y FROM ml0)"))
def eval_binary(spark, sf_dir):
    """Confusion counts, precision/recall/F1, exact ROC-AUC and average
    precision of the rule-fallback probability against the planted label."""
    d = _scored(spark, sf_dir, DEF).withColumn(ML.LABEL, planted_fraud())
    return ML.eval_binary(d, "xgb_prob")


@register("calibrate", with_txn("""
SELECT account_id, seq, least(greatest(0.7 * (100.0 / (1.0 + exp(-0.12 * (ml_score * 2.5 - 50.0)))) + 0.3 * (ml_score * 2.5), 0.0), 100.0) AS calibrated
FROM ml""", *scoring_ctes(DEF)))
def calibrate(spark, sf_dir):
    """Sigmoid stretch calibration of a 0-100 score (applied to 2.5 x ML score)."""
    d = _scored(spark, sf_dir, DEF)
    return d.select("account_id", "seq", C.calibrate(F.col("ml_score") * 2.5).alias("calibrated"))


@register("train_models")
def train_models(spark, sf_dir):
    """RF + isotonic-calibrated GBT + isolation forest on the planted label;
    metrics on the hash-stratified test split (rows-only check)."""
    return metrics(spark, sf_dir)


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """Per-model metrics with the best model by average precision."""
    return ML.model_comparison(metrics(spark, sf_dir))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Random-forest feature importances by name."""
    return ML.feature_importance(spark, fitted(spark, sf_dir, ("rf",)).rf)


@register("score_with_models")
def score_with_models(spark, sf_dir):
    """Flagship scoring with trained models (iso / GBT / RF components live;
    dominant signal from rule base vs ML bonus)."""
    models = fitted(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/ledgerlens-models-{uuid.uuid4().hex}"
    models.save(path)
    loaded = ML.FraudModels.load(spark, path)
    s = S.score_transactions(txn(spark, sf_dir), DEF, models=loaded)
    return s.select("account_id", "seq", "ml_score", "score_iso_component", "score_xgb_component",
                    "final_risk_score", "dominant_signal", "risk_category", "combined_reason")

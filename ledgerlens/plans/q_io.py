"""Registered source / sink / report-shaped queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import analytics as A
from ledgerlens.operators import ml as ML
from ledgerlens.operators import report as RP
from ledgerlens.operators import scoring as S
from ledgerlens.operators import standardize as ST
from ledgerlens.plans.q_scoring import scored as _scored
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlparts import TXN_ORDERS_CTE, with_txn
from ledgerlens.session import checkpoint_dir
from ledgerlens.sources import statements as SS
from ledgerlens.sources.tables import txn, txn_orders

FIX = Config.fixture()


def scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "ledgerlens-io", f"{name}-{uuid.uuid4().hex[:8]}")


@register("src_statement_csv", with_txn("""
SELECT account_id, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS total_amount FROM txn GROUP BY account_id"""))
def src_statement_csv(spark, sf_dir):
    """Statement CSVs (one folder per account) read as strings, standardized."""
    path = scratch(spark, "statements")
    SS.write_statements(SS.render_layout_a(txn(spark, sf_dir)), path)
    std = ST.standardize(SS.read_statements(spark, path), keep=["account_id", "seq"])
    return std.groupBy(F.col("account_id").cast("long").alias("account_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total_amount"))


def _training_csv(spark, sf_dir):
    path = scratch(spark, "training")
    SS.render_training_a(txn(spark, sf_dir)).drop("seq").write.option("header", True).csv(path)
    return path


@register("src_training_csv", with_txn("""
SELECT CASE WHEN amount > 20000 OR ((seq * 7919) % 1000) < 20 THEN 1 ELSE 0 END AS is_fraud, count(*) AS count,
       CAST(sum(amount) AS DOUBLE) AS total_amount FROM txn GROUP BY 1"""))
def src_training_csv(spark, sf_dir):
    """Labelled CSV load of every row: class counts and amounts."""
    d = ST.map_training_format(SS.load_training(spark, _training_csv(spark, sf_dir)))
    return d.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("count"),
                                     F.sum(F.col("amount").cast("decimal(18,2)")).alias("total_amount"))


@register("src_training_csv_sample", with_txn("""
SELECT least(1000, count(*)) AS rows FROM txn"""))
def src_training_csv_sample(spark, sf_dir):
    """The stable 1 000-row sample of the labelled CSV (a feature of the loader)."""
    d = ST.map_training_format(SS.load_training(spark, _training_csv(spark, sf_dir), sample=1000))
    return d.agg(F.count(F.lit(1)).alias("rows"))


@register("sink_transactions", with_txn("""
SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows FROM txn GROUP BY 1"""))
def sink_transactions(spark, sf_dir):
    """Append the canonical table partitioned by month; read back with pruning."""
    path = scratch(spark, "transactions")
    SS.write_table(txn(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


@register("sink_report_json")
def sink_report_json(spark, sf_dir):
    """Per-account portfolio summary written as JSON and read back (rows-only)."""
    path = scratch(spark, "report")
    s = RP.portfolio_summary(_scored(spark, sf_dir, FIX), FIX)
    SS.write_json(s, path)
    return spark.read.json(path)


@register("sink_scored_csv")
def sink_scored_csv(spark, sf_dir):
    """Scored rows (arrays joined) written as CSV and read back (rows-only)."""
    path = scratch(spark, "scored")
    s = _scored(spark, sf_dir, FIX).select(
        "account_id", "seq", "final_risk_score", "risk_category", "rule_flags", "rule_reasons", "combined_reason")
    SS.write_csv(s, path)
    return spark.read.option("header", True).csv(path)


@register("sink_flagged_csv")
def sink_flagged_csv(spark, sf_dir):
    """Portfolio flag table exported as CSV without an index (rows-only)."""
    from ledgerlens.operators import portfolio as P
    path = scratch(spark, "flagged")
    SS.write_csv(P.flag_table(txn(spark, sf_dir), Config(), 20000.0), path)
    return spark.read.option("header", True).csv(path)


@register("sink_training_metrics")
def sink_training_metrics(spark, sf_dir):
    """Evaluation metrics written as JSON and read back (rows-only)."""
    from ledgerlens.sources.statements import planted_fraud
    path = scratch(spark, "metrics")
    d = _scored(spark, sf_dir, Config()).withColumn(ML.LABEL, planted_fraud())
    SS.write_json(ML.eval_binary(d, "xgb_prob").withColumn("model", F.lit("rule_fallback")), path)
    return spark.read.json(path)


@register("analytics_report")
def analytics_report(spark, sf_dir):
    """Per-account report: statistics, insights and chart series as one JSON
    document (rows-only)."""
    t = txn(spark, sf_dir)
    stats = A.summary_statistics(t)
    ins = A.insights(t)
    charts = chart_frame(t).select("account_id", F.struct(*CHARTS).alias("charts"))
    j = stats.join(ins.select("account_id", "top_merchants", "wow_change_pct", "mom_change_pct"), "account_id", "left") \
        .join(charts, "account_id", "left")
    return j.select("account_id", F.to_json(F.struct(*[c for c in j.columns if c != "account_id"])).alias("report"))


CHARTS = {
    # chart: (operator's frame, label, value, order)
    "daily_volume": (A.daily_volume, "date", "total_amount", "date"),
    "monthly_debit": (A.monthly_trends, "month", "total_debit", "month"),
    "monthly_credit": (A.monthly_trends, "month", "total_credit", "month"),
    "monthly_net": (A.monthly_trends, "month", "net", "month"),
    "debit_vs_credit": (A.debit_credit_analysis, "side", "total", "side"),
    "top_merchants": (A.top_merchants, "merchant", "total_amount", "rank"),
    "transaction_types": (A.txn_type_distribution, "transaction_type", "count", "transaction_type"),
    "spending_trend": (A.monthly_spending, "month", "total_debit", "month"),
}


def chart_series(t):
    """(account_id, chart, sort, label, value): the points of every chart."""
    out = None
    for chart, (frame, label, value, order) in CHARTS.items():
        rank = F.col(order).cast("string") if order != "rank" else F.lpad(F.col(order).cast("string"), 4, "0")
        points = frame(t).select("account_id", F.lit(chart).alias("chart"), rank.alias("sort"),
                                 F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
        out = points if out is None else out.unionByName(points)
    return out


def chart_frame(t):
    """One row per account with a series column per chart (bounded by periods / top-n)."""
    point = F.struct("sort", "label", "value")
    wide = chart_series(t).groupBy("account_id").pivot("chart", list(CHARTS)).agg(F.array_sort(F.collect_list(point)))
    cut = lambda c: F.transform(F.col(c), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))
    return wide.select("account_id", *[cut(c).alias(c) for c in CHARTS])


@register("chart_data")
def chart_data(spark, sf_dir):
    """Label/value chart series per account (bounded by periods / top-n;
    rows-only)."""
    c = chart_frame(txn(spark, sf_dir))
    return c.select("account_id", F.to_json(F.struct(*[x for x in c.columns if x != "account_id"])).alias("charts"))


@register("union_training", with_txn(f"""
SELECT is_fraud, count(*) AS count FROM (
  SELECT CASE WHEN amount > 20000 OR ((seq * 7919) % 1000) < 20 THEN 1 ELSE 0 END AS is_fraud FROM txn
  UNION ALL SELECT CASE WHEN debit_credit = 'Credit' THEN 1 ELSE 0 END AS is_fraud FROM txn_orders)
GROUP BY is_fraud""", TXN_ORDERS_CTE))
def union_training(spark, sf_dir):
    """Two labelled datasets (layout A, generic) mapped, reduced to their
    shared columns and unioned; class counts."""
    a = ST.map_training_format(SS.render_training_a(txn(spark, sf_dir)))
    o = txn_orders(spark, sf_dir).select(F.col("amount").cast("string").alias("amount"),
                                         F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                                         (F.col("debit_credit") == "Credit").cast("int").cast("string").alias("is_fraud"))
    b = ST.map_training_format(o)
    shared = [c for c in a.columns if c in b.columns]
    u = a.select(*shared).unionByName(b.select(*shared))
    return u.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("count"))


@register("fraud_type_model")
def fraud_type_model(spark, sf_dir):
    """Learned fraud type inside scoring: a multiclass forest on the model features, trained on the
    training part of layout A's classes, names the type of the held-out rows whose ML score
    reaches the threshold (rows-only)."""
    from ledgerlens.operators import features as FE
    from ledgerlens.operators import ml as ML
    from ledgerlens.operators import scoring as S
    raw = SS.render_training_a(txn(spark, sf_dir))
    labels = ST.map_training_format(raw).select("account_id", "seq", "fraud_type_label")
    d = FE.engineer_features(txn(spark, sf_dir)).join(labels, ["account_id", "seq"])
    train, test = ML.stratified_split(d, label="fraud_type_label")
    codes = ST.dense_codes(raw.select("fraud_type").distinct(), "fraud_type", "code", start=1)
    names = {r["code"]: r["fraud_type"] for r in codes.orderBy("code").limit(1000).collect()}       # one row per class
    names[0] = "Normal"
    model, names = ML.train_fraud_type(train, names)
    models = ML.FraudModels(fraud_type=model, type_names=names)
    held = txn(spark, sf_dir).join(test.select("account_id", "seq"), ["account_id", "seq"], "left_semi")
    # without the other models the score stays low: the threshold of the fused score scaled down
    s = S.score_transactions(held, Config(fraud_type_threshold=10.0), models=models)
    return s.select("account_id", "seq", "fraud_type_predicted")


@register("map_predict_format", with_txn("""
SELECT account_id, seq, CAST(amount AS DOUBLE) AS amount, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
       merchant, mode, CAST(balance AS DOUBLE) AS balance_after FROM txn"""))
def map_predict_format(spark, sf_dir):
    """A user's prediction file mapped by first-present candidate columns."""
    raw = txn(spark, sf_dir).select("account_id", "seq", F.col("amount").cast("string").alias("Amount"),
                                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"),
                                    F.col("merchant").alias("Merchant"), F.col("mode").alias("Channel"),
                                    F.col("balance").cast("string").alias("AccountBalance"))
    return ST.map_predict_format(raw).select("account_id", "seq", "amount", "hour", "day_of_week", "merchant", "mode", "balance_after")


@register("prep_cashflow", with_txn("""
SELECT account_id, seq, strftime(date, '%Y-%m-%d') AS date, debit_credit, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, narration FROM txn"""))
def prep_cashflow(spark, sf_dir):
    """Raw export columns (type, valueDate, currentBalance, narration) prepared
    for the cash-flow forecast."""
    raw = SS.render_layout_a(txn(spark, sf_dir)).withColumn("amount", F.regexp_replace("amount", ",", ""))
    p = ST.prep_cashflow(raw)
    return p.select("account_id", "seq", F.to_date("date").alias("date"), "debit_credit", "amount", "balance", "narration")


@register("clean_currency", with_txn("""
SELECT account_id, seq, CAST(amount AS DOUBLE) AS amount_signed, CAST(amount AS DOUBLE) AS amount_compat FROM txn"""))
def clean_currency(spark, sf_dir):
    """'$1,234.50'-style money text to numbers (sign-keeping and compat modes)."""
    raw = SS.render_layout_c(txn(spark, sf_dir))
    return raw.select("account_id", "seq", ST.clean_currency(F.col("Txn-Amount")).alias("amount_signed"),
                      ST.clean_currency(F.col("Txn-Amount"), compat=True).alias("amount_compat"))

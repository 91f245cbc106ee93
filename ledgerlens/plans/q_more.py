"""Remaining inventory keys: channel, label encoding, anomaly input, feature
vector, fraud-type training, tree-vote confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import analytics as A
from ledgerlens.operators import cashflow as CF
from ledgerlens.operators import features as FE
from ledgerlens.operators import ml as ML
from ledgerlens.operators import scoring as S
from ledgerlens.operators import standardize as ST
from ledgerlens.plans.q_keys import project
from ledgerlens.config import Config
from ledgerlens.operators import portfolio as P
from ledgerlens.operators import report as RP
from ledgerlens.plans.q_io import FIX, chart_frame, scratch
from ledgerlens.plans.q_ml import PLANTED, labelled
from ledgerlens.plans.q_report import scored
from ledgerlens.plans.registry import REGISTRY, register
from ledgerlens.plans.sqlparts import TXN_ORDERS_CTE, with_txn
from ledgerlens.sources import statements as SS
from ledgerlens.sources import statements as SS
from ledgerlens.sources.tables import txn, txn_orders

project("channel", "merchant_key", ["account_id", "seq", "channel"], "Channel: mode unless blank/OTHERS, else first narration token.")


@register("feat_encode_label", with_txn("""
SELECT account_id, seq, dense_rank() OVER (ORDER BY merchant) - 1 AS merchant_code,
       dense_rank() OVER (ORDER BY mode) - 1 AS mode_code,
       dense_rank() OVER (ORDER BY transaction_type) - 1 AS type_code FROM txn"""))
def feat_encode_label(spark, sf_dir):
    """LabelEncoder codes: rank of each value among the sorted distinct values
    (sorted distinct + zipWithIndex, joined back; no global window)."""
    d = txn(spark, sf_dir).select("account_id", "seq", "merchant", "mode", "transaction_type")
    d = ST.dense_codes(d, "merchant", "merchant_code")
    d = ST.dense_codes(d, "mode", "mode_code")
    d = ST.dense_codes(d, "transaction_type", "type_code")
    return d.select("account_id", "seq", "merchant_code", "mode_code", "type_code")


@register("feat_anomaly_raw", with_txn("SELECT account_id, seq, 0.0::DOUBLE AS anomaly_score_raw FROM txn"))
def feat_anomaly_raw(spark, sf_dir):
    """Provided anomaly score or 0 (the events fixture provides none)."""
    return FE.engineer_features(txn(spark, sf_dir)).select("account_id", "seq", "anomaly_score_raw")


_SIGNALS = ("(seq % 97) / 97.0", "(seq % 53) * 1.5", "(seq % 31) * 0.25")


def _with_signals(spark, sf_dir, names):
    """The transactions with provided signals in text, as an upstream system would send them."""
    n = lambda m: F.pmod(F.col("seq"), F.lit(m))
    given = {"anomaly_score": n(97) / 97.0, "spending_deviation_score": n(53) * 1.5, "geo_anomaly_score": n(31) * 0.25}
    return txn(spark, sf_dir).withColumns({k: given[k].cast("string") for k in names})


@register("feat_anomaly_given", with_txn(f"SELECT account_id, seq, {_SIGNALS[0]} AS anomaly_score_raw FROM txn"))
def feat_anomaly_given(spark, sf_dir):
    """A provided anomaly score becomes the model's feature."""
    return FE.engineer_features(_with_signals(spark, sf_dir, ["anomaly_score"])).select("account_id", "seq", "anomaly_score_raw")


@register("score_spending_given", with_txn(f"""
SELECT account_id, seq, round(least({_SIGNALS[1]} / (max({_SIGNALS[1]}) OVER (PARTITION BY account_id) + 1e-9), 1.0), 9) AS score
FROM txn"""))
def score_spending_given(spark, sf_dir):
    """A provided spending deviation score replaces the amount's deviation."""
    s = S.score_transactions(_with_signals(spark, sf_dir, ["spending_deviation_score"]))
    return s.select("account_id", "seq", F.round("score_spending_dev", 9).alias("score"))


@register("score_geo_given", with_txn(f"""
SELECT account_id, seq, round(least((least(abs((a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-9)) / 5.0, 1.0)
  + least(g / (max(g) OVER w + 1e-9), 1.0)) / 2.0, 1.0), 9) AS score
FROM (SELECT account_id, seq, CAST(amount AS DOUBLE) AS a, {_SIGNALS[2]} AS g FROM txn) WINDOW w AS (PARTITION BY account_id)"""))
def score_geo_given(spark, sf_dir):
    """A provided geo anomaly score is averaged with the amount's deviation."""
    s = S.score_transactions(_with_signals(spark, sf_dir, ["geo_anomaly_score"]))
    return s.select("account_id", "seq", F.round("score_spending_dev", 9).alias("score"))


@register("feat_vector")
def feat_vector(spark, sf_dir):
    """The 21 features assembled into one vector (size and norm per row; rows-only)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    d = FE.engineer_features(txn(spark, sf_dir))
    v = VectorAssembler(inputCols=FE.FEATURE_COLS, outputCol="v", handleInvalid="keep").transform(d)
    a = vector_to_array("v")
    return v.select("account_id", "seq", F.size(a).alias("size"),
                    F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)).alias("norm"))


@register("train_fraud_type")
def train_fraud_type(spark, sf_dir):
    """Multiclass fraud-type forest on layout-A codes: held-out (hash 20 %)
    accuracy and class count (rows-only)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    d = ST.map_training_format(SS.render_training_a(txn(spark, sf_dir)))
    tr, te = ML.stratified_split(d, label="fraud_type_label")
    feats = ["amount", "hour", "day_of_week", "is_weekend", "month", "balance_after", "balance_before", "anomaly_score_raw"]
    rf = RandomForestClassifier(labelCol="fraud_type_label", featuresCol="f", numTrees=50, maxDepth=8, seed=42)
    tr = ML.dealt(tr.select("seq", "fraud_type_label", *feats))
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="f"), rf]).fit(tr)
    p = model.transform(te)
    return p.agg((F.avg((F.col("prediction") == F.col("fraud_type_label")).cast("double"))).alias("accuracy"),
                 F.count_distinct("fraud_type_label").alias("classes"), F.count(F.lit(1)).alias("test_rows"))


@register("score_confidence")
def score_confidence(spark, sf_dir):
    """1 - std of the forest's per-tree fraud probabilities for each txn (rows-only)."""
    from ledgerlens.plans.q_ml import fitted
    return ML.score_confidence(FE.engineer_features(txn(spark, sf_dir)), fitted(spark, sf_dir, ("rf",)).rf)


def _parent(name: str) -> str:
    return REGISTRY[name].sql


_CHART_SQL = "\nUNION ALL\n".join(
    f"SELECT account_id, '{chart}' AS chart, CAST({label} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value FROM ({_parent(parent)}) q"
    for chart, parent, label, value in (
        ("daily_volume", "daily_volume", "date", "total_amount"), ("monthly_debit", "monthly_trends", "month", "total_debit"),
        ("monthly_credit", "monthly_trends", "month", "total_credit"), ("monthly_net", "monthly_trends", "month", "net"),
        ("debit_vs_credit", "debit_credit_analysis", "side", "total"), ("top_merchants", "top_merchants", "merchant", "total_amount"),
        ("transaction_types", "txn_type_distribution", "transaction_type", "count"),
        ("spending_trend", "monthly_spending", "month", "total_debit")))


@register("chart_series", _CHART_SQL)
def chart_series(spark, sf_dir):
    """Every point of every chart, taken back out of the JSON documents."""
    c = chart_frame(txn(spark, sf_dir))
    names = [x for x in c.columns if x != "account_id"]
    doc = c.select("account_id", F.to_json(F.struct(*names)).alias("j"))
    kind = "map<string,array<struct<label:string,value:double>>>"
    return (doc.select("account_id", F.explode(F.from_json("j", kind)).alias("chart", "points"))
            .select("account_id", "chart", F.explode("points").alias("p")).select("account_id", "chart", "p.label", "p.value"))


@register("sink_report_rows", _parent("portfolio_summary"))
def sink_report_rows(spark, sf_dir):
    """The portfolio summary written as JSON, read back with its schema."""
    s = RP.portfolio_summary(scored(spark, sf_dir), FIX)
    path = scratch(spark, "report-rows")
    SS.write_json(s, path)
    return spark.read.schema(s.schema).json(path)


@register("sink_scored_rows", "SELECT account_id, seq, round(final_risk_score, 6) AS final_risk_score, risk_category, "
          f"coalesce(rule_flags, '') AS rule_flags, combined_reason FROM ({_parent('score_transactions_fixture')}) q")
def sink_scored_rows(spark, sf_dir):
    """Scored rows written as CSV (arrays joined), read back and typed."""
    path = scratch(spark, "scored-rows")
    SS.write_csv(scored(spark, sf_dir).select("account_id", "seq", "final_risk_score", "risk_category", "rule_flags", "combined_reason"), path)
    d = spark.read.option("header", True).csv(path)
    return d.select(F.col("account_id").cast("long"), F.col("seq").cast("long"),
                    F.round(F.col("final_risk_score").cast("double"), 6).alias("final_risk_score"), "risk_category",
                    F.coalesce("rule_flags", F.lit("")).alias("rule_flags"), "combined_reason")


@register("sink_flagged_rows", _parent("p_flag_table"))
def sink_flagged_rows(spark, sf_dir):
    """The portfolio flag table written as CSV, read back with its schema."""
    flags = P.flag_table(txn(spark, sf_dir), Config(), 20000.0)
    path = scratch(spark, "flagged-rows")
    SS.write_csv(flags, path)
    return spark.read.schema(flags.schema).option("header", True).csv(path)


@register("balance_classes_weights", with_txn(f"""
SELECT is_fraud, total / (2.0 * n_train) AS weight, n_train AS rows
FROM (SELECT is_fraud, n - greatest(CAST(round(n * 0.2) AS BIGINT), CASE WHEN n > 1 THEN 1 ELSE 0 END) AS n_train,
             sum(n - greatest(CAST(round(n * 0.2) AS BIGINT), CASE WHEN n > 1 THEN 1 ELSE 0 END)) OVER () AS total
      FROM (SELECT {PLANTED} AS is_fraud, count(*) AS n FROM txn GROUP BY 1))"""))
def balance_classes_weights(spark, sf_dir):
    """Class weights n / (2 n_class) of the exact training split."""
    tr, _ = ML.stratified_split(labelled(spark, sf_dir))
    return ML.with_class_weights(tr).groupBy(ML.LABEL, "weight").agg(F.count(F.lit(1)).alias("rows"))


@register("narrative_totals", f"""
SELECT k.account_id, k.transaction_count AS total_transactions, round(k.total_credit - k.total_debit, 2) AS net_cash_flow,
       m.merchant AS first_merchant, c.runway_days, c.risk_classification AS risk_level
FROM ({_parent("kpis")}) k LEFT JOIN (SELECT * FROM ({_parent("top_merchants")}) t WHERE rank = 1) m USING (account_id)
LEFT JOIN ({_parent("cashflow")}) c USING (account_id)""")
def narrative_totals(spark, sf_dir):
    """Fields of the narrative payload's totals, merchants and cash flow, taken back out of its JSON."""
    p = RP.narrative_payload(scored(spark, sf_dir), FIX)
    at = lambda path: F.get_json_object("payload", path)
    return p.select("account_id", at("$.totals.total_transactions").cast("long").alias("total_transactions"),
                    F.round(at("$.totals.net_cash_flow").cast("double"), 2).alias("net_cash_flow"),
                    at("$.top_merchants[0].merchant").alias("first_merchant"),
                    at("$.cash_flow.runway_days").cast("int").alias("runway_days"),
                    at("$.cash_flow.risk_level").alias("risk_level"))


_OTHER_NAMES = """
SELECT account_id, seq, CAST(amount AS DOUBLE) AS amount_f, 999999.0::DOUBLE AS balance_after,
       999999.0 + CASE WHEN debit_credit = 'Credit' THEN -CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS balance_before,
       hour(ts) AS hour, month(ts) AS month, merchant, mode, mode AS transaction_type, debit_credit, time
FROM txn"""


@register("feat_columns_resolved", with_txn(_OTHER_NAMES))
def feat_columns_resolved(spark, sf_dir):
    """Features of an export with other column names, without a balance and a transaction type:
    first candidates present, 999999 for the balance."""
    t = txn(spark, sf_dir)
    export = t.select("account_id", "seq", F.col("amount").cast("string").alias("Transaction Amount"),
                      F.col("date").cast("string").alias("TransactionDate"), F.col("time").alias("Time"),
                      F.col("merchant").alias("MerchantID"), F.col("mode").alias("Channel"),
                      F.col("debit_credit").alias("debit/credit"))
    d = FE.row_features(export)
    return d.select("account_id", "seq", "amount_f", "balance_after", "balance_before", "hour", "month", "merchant", "mode",
                    "transaction_type", "debit_credit", "time")


@register("feat_columns_none", with_txn("""
SELECT seq, 0.0::DOUBLE AS amount_f, 999999.0::DOUBLE AS balance_after, 12 AS hour, 1 AS month, 0 AS day_of_week,
       'UNKNOWN' AS merchant, 'UNKNOWN' AS mode, 'UNKNOWN' AS transaction_type, 'DEBIT' AS debit_credit FROM txn"""))
def feat_columns_none(spark, sf_dir):
    """Features of a table that has none of the candidates: every default."""
    d = FE.row_features(txn(spark, sf_dir).select("seq"))
    return d.select("seq", "amount_f", "balance_after", "hour", "month", "day_of_week", "merchant", "mode",
                    "transaction_type", "debit_credit")


@register("sink_report_modules", f"""
SELECT s.account_id, s.transaction_count, s.total_debit, s.median_transaction, f.flagged_count, f.max_final_risk_score,
       f.peak_fraud_day, c.runway_days, c.risk_classification, f.flagged_count AS flagged_in_module
FROM ({REGISTRY["summary_statistics"].sql}) s JOIN ({REGISTRY["portfolio_summary"].sql}) f USING (account_id)
JOIN ({REGISTRY["cashflow"].sql}) c USING (account_id)""")
def sink_report_modules(spark, sf_dir):
    """One JSON document per module (statistics, fraud, cash flow, narrative input) and a master per account,
    written and read back."""
    t, rows = txn(spark, sf_dir), scored(spark, sf_dir)
    path = scratch(spark, "report-modules")
    master = SS.write_report({"statistics": A.summary_statistics(t), "fraud": RP.portfolio_summary(rows, FIX),
                              "cashflow": CF.report(t, Config()), "llm_input": RP.narrative_payload(rows, FIX)}, path)
    fraud = spark.read.json(f"{path}/fraud").select("account_id", F.col("flagged_count").alias("flagged_in_module"))
    return master.join(fraud, "account_id").select(
        "account_id", "statistics.transaction_count", "statistics.total_debit", "statistics.median_transaction",
        "fraud.flagged_count", "fraud.max_final_risk_score", "fraud.peak_fraud_day", "cashflow.runway_days",
        "cashflow.risk_classification", "flagged_in_module")


@register("distinct_span_sketch", with_txn("""
SELECT transaction_type, count(DISTINCT account_id) AS accounts, true AS within_bound
FROM txn_orders WHERE strftime(date, '%Y-%m') BETWEEN '1994-03' AND '1997-10' GROUP BY transaction_type""", TXN_ORDERS_CTE))
def distinct_span_sketch(spark, sf_dir):
    """Distinct accounts per transaction type over a span of months: sketches stored by month and merged,
    held against the exact count."""
    t, by, span = txn_orders(spark, sf_dir), ["transaction_type"], ("1994-03", "1997-10")
    path = scratch(spark, "sketches")
    A.distinct_sketches(t, "account_id", by).write.partitionBy("month").parquet(path)
    merged = A.distinct_in_span(spark.read.schema("transaction_type string, sketch binary, month string").parquet(path), *span, by)
    exact = (t.where(F.date_format("date", "yyyy-MM").between(*span)).groupBy(*by)
             .agg(F.count_distinct("account_id").alias("accounts")))
    off = F.abs(F.col("distinct_values") - F.col("accounts"))
    return exact.join(merged, by).select(*by, "accounts", (off <= F.col("accounts") * A.SKETCH_BOUND).alias("within_bound"))

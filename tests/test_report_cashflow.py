"""Episode gap boundaries, card testing, risk bands, cash-flow edges."""
import datetime as dt

from pyspark.sql import functions as F

from helpers import at, txn_rows
from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.operators import cashflow as CF
from ledgerlens.operators import report as RP


def _scored(spark, rows):
    import decimal
    base = [(1, i, at(s), decimal.Decimal(amt), 70.0, [], 0, 0, "Normal", 10.0, 0)
            for i, (s, amt) in enumerate(rows)]
    return spark.createDataFrame(base, "account_id long, seq long, ts timestamp, amount decimal(18,2), "
                                       "final_risk_score double, rule_flags array<string>, is_near_threshold int, "
                                       "balance_zeroed_out int, fraud_type_predicted string, ml_score double, rule_score int")


def test_episode_gap_boundaries(spark):
    h = 3600
    # gaps: 23 h (same), 24 h exactly (same), 24 h + 1 s (new)
    secs = [0, 23 * h, 47 * h, 71 * h + 1]
    e = RP.episode_ids(_scored(spark, [(s, 100) for s in secs]), Config())
    assert [r.episode_id for r in e.orderBy("seq").collect()] == [1, 1, 1, 2]


def test_card_testing_pattern(spark):
    eps = RP.episodes(_scored(spark, [(0, 400), (600, 6000), (1200, 6500)]), Config()).collect()
    assert len(eps) == 1 and eps[0].card_testing and eps[0].attack_pattern == "Card Testing"


def test_risk_bands_contiguous_and_compat(spark):
    vals = [0.0, 20.0, 20.5, 21.0, 40.5, 60.5, 61.0, 80.5, 95.5, 96.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r.c for r in df.select(C.risk_category(F.col("s")).alias("c")).collect()]
    assert got == ["Very Low", "Very Low", "Low", "Low", "Medium", "High", "High", "Very High", "Critical",
                   "Critical", "Critical"]
    compat = [r.c for r in df.select(C.risk_category(F.col("s"), compat=True).alias("c")).collect()]
    assert compat[2] == "Critical" and compat[5] == "Critical" and compat[1] == "Very Low"


def test_cashflow_rate_zero_and_negative_balance(spark):
    rows = [{"ts": at(d * 86400), "amount": 100, "debit_credit": "Credit", "balance": -50} for d in range(3)]
    m = CF.forecast(CF.metrics(txn_rows(spark, rows), Config()), Config()).collect()[0]
    assert m.runway_days is None and m.risk_classification == "UNKNOWN"
    assert m.calendar_days == 3


def test_outliers_need_twenty_debits(spark):
    rows = [{"ts": at(i * 60), "amount": 10 + i} for i in range(19)]
    assert CF.outliers(txn_rows(spark, rows), Config()).count() == 0
    rows.append({"ts": at(5000), "amount": 100000})
    o = CF.outliers(txn_rows(spark, rows), Config()).collect()
    assert o[0].outlier_count == 1 and float(o[0].largest_outlier) == 100000.0

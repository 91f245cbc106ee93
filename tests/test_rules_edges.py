"""Edge-case tables for the seven rules (boundaries, ties, blanks)."""
from pyspark.sql import functions as F

from helpers import at, txn_rows
from ledgerlens.config import Config
from ledgerlens.operators import rules as R


def _flags(df, col):
    return {r.seq for r in df.where(F.col(col)).select("seq").collect()}


def test_rapid_window_is_inclusive_at_half_width(spark):
    # 5 rows at 0/60/150/240/300 s: all within +/-300 s of the row at 150 s
    secs = [0, 60, 150, 240, 300, 601]
    df = txn_rows(spark, [{"ts": at(s), "amount": 10} for s in secs])
    e = R.evaluate(df, Config(), rules=("RAPID_TRANSACTION",))
    counts = {r.seq: r.rapid_count for r in e.select("seq", "rapid_count").collect()}
    assert counts == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5, 5: 1}
    assert _flags(e, "r_rapid") == {0, 1, 2, 3, 4}


def test_rapid_skips_rows_without_time(spark):
    df = txn_rows(spark, [{"ts": at(s), "amount": 10, "time": ""} for s in range(0, 50, 10)])
    e = R.evaluate(df, Config(), rules=("RAPID_TRANSACTION",))
    assert _flags(e, "r_rapid") == set()


def test_repeated_tolerance_is_asymmetric(spark):
    # 100 vs 98: |2|/100 = 2 % (ok); 98 vs 100: 2/98 = 2.04 % (not ok)
    rows = [{"ts": at(0), "amount": 100}, {"ts": at(3600), "amount": 102}, {"ts": at(7200), "amount": 98}]
    e = R.evaluate(txn_rows(spark, rows), Config(), rules=("REPEATED_TRANSACTION",))
    partners = {r.seq: r.repeat_partners for r in e.select("seq", "repeat_partners").collect()}
    assert partners[0] == 2          # 102 (2 %) and 98 (2 %)
    assert partners[2] == 0          # |98-100|/98 = 2.04 % and |98-102|/98 > 2 %: none
    assert _flags(e, "r_repeated") == {0}


def test_repeated_window_24h_inclusive_and_zero_amounts(spark):
    rows = [{"ts": at(0), "amount": 0}, {"ts": at(86400), "amount": 0}, {"ts": at(2 * 86400), "amount": 0},
            {"ts": at(0), "amount": 50, "merchant": "OTHER"}]
    e = R.evaluate(txn_rows(spark, rows), Config(), rules=("REPEATED_TRANSACTION",))
    partners = {r.seq: r.repeat_partners for r in e.select("seq", "repeat_partners").collect()}
    assert partners[1] == 2 and partners[0] == 1 and partners[2] == 1
    assert _flags(e, "r_repeated") == {1}


def test_repeated_equals_brute_force_on_fixture(spark):
    from ledgerlens.sources.tables import txn
    cfg = Config.fixture().with_(repeated_tolerance=0.10, repeated_window_hours=72)
    t = txn(spark, "/root/testdata/sf0.001", cfg)
    got = {(r.account_id, r.seq): r.repeat_partners for r in R.repeated_counts(R.prepare(t, cfg), cfg).collect()}
    rows = t.select("account_id", "seq", "mode", F.unix_micros("ts").alias("us"), F.col("amount").cast("double").alias("a")).collect()
    w = 72 * 3600 * 1_000_000
    for r in rows:
        exp = sum(1 for s in rows if s.account_id == r.account_id and s.mode == r.mode and s.seq != r.seq
                  and abs(s.us - r.us) <= w and abs(r.a - s.a) / abs(r.a) <= 0.10)
        assert got.get((r.account_id, r.seq), 0) == exp


def test_high_value_skips_zero_channel_median(spark):
    rows = [{"ts": at(i), "amount": 0} for i in range(3)] + [{"ts": at(10), "amount": 9000}]
    e = R.evaluate(txn_rows(spark, rows), Config(), rules=("HIGH_VALUE_TRANSACTION",))
    assert _flags(e, "r_high_value") == set()


def test_spike_needs_seven_days(spark):
    six = [{"ts": at(d * 86400), "amount": 100} for d in range(5)] + [{"ts": at(5 * 86400), "amount": 50000}]
    e = R.evaluate(txn_rows(spark, six), Config(), rules=("SPENDING_SPIKE",))
    assert _flags(e, "r_spending_spike") == set()
    seven = six + [{"ts": at(6 * 86400), "amount": 100}]
    e = R.evaluate(txn_rows(spark, seven), Config(), rules=("SPENDING_SPIKE",))
    assert _flags(e, "r_spending_spike") == {5}


def test_balance_drop_opening_non_positive_skipped(spark):
    rows = [{"ts": at(0), "amount": 10, "balance": 0}, {"ts": at(60), "amount": 500, "balance": -10},
            {"ts": at(86400), "amount": 10, "balance": 1000}, {"ts": at(86460), "amount": 500, "balance": 500}]
    e = R.evaluate(txn_rows(spark, rows), Config(), rules=("BALANCE_DROP_ALERT",))
    assert _flags(e, "r_balance_drop") == {3}


def test_late_night_boundaries(spark):
    rows = [{"ts": at(0), "time": t, "amount": 2000} for t in ["23:00:00", "04:59:59", "05:00:00", "22:59:59", "xx"]]
    e = R.evaluate(txn_rows(spark, rows), Config(), rules=("LATE_NIGHT_TRANSACTION",))
    assert _flags(e, "r_late_night") == {0, 1}


def test_rule_engine_orders_flags_and_sums_points(spark):
    rows = [{"ts": at(i * 10), "time": "23:30:00", "amount": 3000, "mode": "ATM", "transaction_type": "ATM",
             "narration": "ATM/X", "balance": 5000} for i in range(5)]
    s = R.rule_engine(txn_rows(spark, rows), Config()).collect()
    for r in s:
        assert r.rule_flags == ["REPEATED_TRANSACTION", "EXCESSIVE_WITHDRAWAL", "RAPID_TRANSACTION",
                                "LATE_NIGHT_TRANSACTION", "BALANCE_DROP_ALERT"]
        assert r.rule_score == sum(Config().points[f] for f in r.rule_flags)

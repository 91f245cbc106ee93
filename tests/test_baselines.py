"""Versioned baselines: what a micro-batch is judged by, on first run and on replay."""

import pytest
from helpers import at, txn_rows
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import rules as R
from ledgerlens.streaming.baselines import Baselines, score_days, score_rows


def _rows(df):
    return {(r.seq, r.r_high_value, r.is_large_amount, r.version) for r in df.collect()}


def test_new_version_takes_effect_and_replay_keeps_its_own(spark, tmp_path):
    cfg = Config(high_value_floor=100.0)
    base = Baselines(spark, str(tmp_path / "base"), cfg)
    log = str(tmp_path / "applied")
    with pytest.raises(ValueError, match="no baseline version"):
        base.of_batch(log, 0)
    past = [{"ts": at(i * 3600), "amount": 100} for i in range(20)]
    base.publish(txn_rows(spark, past), 1)
    batch = txn_rows(spark, [{"ts": at(10), "amount": 600}, {"ts": at(20), "amount": 90}, {"ts": None, "amount": None},
                             {"ts": at(30), "amount": 9e6, "account_id": 2}, {"ts": at(40), "amount": 600, "mode": "ATM"}])
    v = base.of_batch(log, 0)
    # an unknown channel has no median, an unknown account no baseline at all
    first = _rows(score_rows(batch, base, v))
    assert first == {(0, True, 1, 1), (4, False, 1, 1)}
    base.publish(txn_rows(spark, [dict(r, amount=500) for r in past]), 2)
    assert base.of_batch(log, 0) == 1 and _rows(score_rows(batch, base, base.of_batch(log, 0))) == first
    assert base.of_batch(log, 1) == 2
    assert _rows(score_rows(batch, base, 2)) == {(0, False, 1, 2), (4, False, 1, 2)}
    with pytest.raises(ValueError, match="does not change"):
        base.publish(txn_rows(spark, past), 2)


def test_unfinished_version_is_not_seen(spark, tmp_path):
    base = Baselines(spark, str(tmp_path), Config())
    df = txn_rows(spark, [{"ts": at(0), "amount": 5}])
    base.publish(df, 1)
    (tmp_path / "published" / "version=2").mkdir()                   # the marker never got to its end
    assert base.published() == [1] and base.of_batch(str(tmp_path / "log"), 0) == 1
    base.publish(df, 2)
    assert base.published() == [1, 2]
    empty = df.where("false")
    base.publish(empty, 3)
    assert score_rows(df, base, 3).count() == 0 and score_rows(empty, base, 1).count() == 0


def test_spike_days_equal_the_batch_rule(spark, tmp_path):
    cfg = Config(spike_floor=50.0)
    rows = [{"ts": at(i * 86_400), "amount": 20 + i} for i in range(9)] + [{"ts": at(3 * 86_400 + 60), "amount": 500}]
    df = txn_rows(spark, rows)
    base = Baselines(spark, str(tmp_path), cfg)
    base.publish(df, 1)
    days = df.groupBy("account_id", "date").agg(F.sum("amount").alias("total_amount"))
    got = {(r.date, float(r.day_total), r.median_day) for r in score_days(days, base, 1).collect()}
    want = {(r.date, float(r.day_total), r.median_day)
            for r in R.daily_stats(R.prepare(df, cfg), cfg).where("spike_day").collect()}
    assert got == want and len(got) == 1

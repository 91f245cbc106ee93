"""Accounts that one task holds: one shuffle of the rows, and the results of the joined statistics."""
import random

import pytest
from pyspark.sql import functions as F

from helpers import at, txn_rows
from ledgerlens.config import Config
from ledgerlens.functions import windows as W
from ledgerlens.operators import report as RP
from ledgerlens.operators import scoring as S
from ledgerlens.session import cut_lineage
from ledgerlens.sources.tables import with_balance


def _odd_rows(spark, n=260):
    """Rows with nulls in every column that a statistic is found by, and some (account, seq) two and three times."""
    draw = random.Random(11)
    rows = []
    for i in range(n):
        ts = at(draw.randrange(0, 12 * 86400, 150)) if draw.random() < 0.93 else None
        rows.append({"account_id": draw.choice([1, 1, 2, 3, None]), "seq": i - draw.choice([0, 0, 0, 1, 2]), "ts": ts,
                     "amount": draw.choice([None, 0, -40, 100, 102, 98, 7000, 25_000, 9_500]), "mode": draw.choice(["UPI", "ATM", "", None]),
                     "balance": draw.choice([None, 0, 500, 90_000]), "merchant": draw.choice(["A", "A", "B", "", None]),
                     "narration": draw.choice(["", "ATM cash", None]), "time": draw.choice([None, None, "", "23:10:00"])})
    # a row's own tie columns tell copies apart nowhere, so copies are alike but for their seq
    d = txn_rows(spark, rows)
    return d.withColumn("seq", F.when(F.col("seq") % 17 != 5, F.col("seq"))).withColumn(
        "balance", F.when(F.col("ts").isNotNull(), F.col("balance")))


def _plain(rows):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


CONFIGS = [Config(), Config.fixture(), Config.fixture().with_(rapid_window_minutes=600, repeated_tolerance=0.0, repeated_window_hours=60),
           Config().with_(repeated_tolerance=1.5, repeated_key="channel", rule_points=Config().rule_points[2:5])]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_statistics_in_place_are_those_joined(spark, cfg):
    df = _odd_rows(spark).where("seq is null or seq % 7 > 0 or balance is null").persist()
    # the day's opening is any of several rows that share (ts, seq): here they share the balance
    df = df.join(df.groupBy("account_id", "ts", "seq").agg(F.max("balance").alias("__b")).select(
        F.col("account_id").alias("__k"), F.col("ts").alias("__t"), F.col("seq").alias("__s"), "__b"),
        F.col("account_id").eqNullSafe(F.col("__k")) & F.col("ts").eqNullSafe(F.col("__t")) & F.col("seq").eqNullSafe(F.col("__s"))
    ).withColumn("balance", F.col("__b")).drop("__k", "__t", "__s", "__b").persist()
    was, now = (f(df, cfg, ["account_id"], True) for f in (S.joined_statistics, S.statistics_in_place))
    assert was.columns == now.columns and [f.dataType for f in was.schema] == [f.dataType for f in now.schema]
    assert _plain(was.collect()) == _plain(now.collect())


def test_scores_do_not_depend_on_what_counts_as_large(spark, monkeypatch):
    df = _odd_rows(spark).dropDuplicates(["account_id", "seq"]).where("seq is not null").persist()
    of = lambda: _plain(S.score_transactions(df, Config.fixture()).select(
        "account_id", "seq", "rule_flags", "rule_reasons", "ml_score", "final_risk_score").collect())
    want = of()
    monkeypatch.setattr(S, "GROUP_ROWS", 70)            # some accounts large
    assert of() == want
    monkeypatch.setattr(S, "GROUP_ROWS", 0)             # all
    assert of() == want
    monkeypatch.setattr(S, "GROUP_ROWS", 50_000)
    monkeypatch.setattr(S.R, "DENSE_ROWS", 12)          # those with many rows of one key
    assert of() == want


@pytest.mark.parametrize("rows", [0, 60, 50_000])
def test_running_sums_and_sessions_by_size(spark, monkeypatch, rows):
    monkeypatch.setattr(W, "GROUP_ROWS", rows)
    df = spark.createDataFrame([(k, i, i * 5000 if i % 9 else None, None if i % 4 else i) for i in range(90) for k in (1, 2, None) if i < 50 or k == 1],
                               "k long, seq long, t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    total = {(r.k, r.seq): r.s for r in W.bucketed_running_sum(df, ["k"], "ts", "seq", "v", "s").collect()}
    ses = {(r.k, r.seq): r.s for r in W.bucketed_sessions(df, ["k"], "ts", "seq", 6000 * 1_000_000, "s").collect()}
    for k, n in ((1, 90), (2, 50), (None, 50)):
        order = sorted(range(n), key=lambda i: (i % 9 == 0, i * 5000 // 86400 if i % 9 else 0, i))
        seen, run, session, last = set(), 0, 1, None
        for i in order:
            day = i * 5000 // 86400 if i % 9 else None
            if i % 4 == 0:
                run, _ = run + i, seen.add(day)
            assert total[k, i] == (run if day in seen else None), (k, i)
            if i % 9:
                session, last = session + (last is not None and i * 5000 - last > 6000), i * 5000
            assert ses[k, i] == session, (k, i)


def test_rows_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = txn_rows(spark, [{"ts": at(s), "amount": 10 + s, "balance": 100} for s in range(0, 300, 60)])
        for out, most in ((with_balance(df), 1), (S.score_transactions(df), 2)):        # and the amount's moments
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert 1 <= plan.count("Exchange hashpartitioning") <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_a_key_far_apart_or_alike_are_not_dense(spark, monkeypatch):
    """What a row of the repeat rule meets are the distinct rows of its window: an account's further days and copies are none."""
    rows = [{"account_id": 1, "seq": i, "ts": at(i * 2 * 86400), "amount": 100 + i % 3, "balance": 900} for i in range(40)]
    rows += [{"account_id": 2, "seq": i, "ts": at(i // 20 * 3600), "amount": 100 + i // 20, "balance": 900} for i in range(60)]
    cfg, df = Config.fixture(), txn_rows(spark, rows).persist()
    of = lambda: {(r.account_id, r.seq): (r.repeat_partners, r.ml_score) for r in S.score_transactions(df, cfg).collect()}
    want = of()
    assert {want[1, i][0] for i in range(40)} == {0} and {want[2, i][0] for i in range(60)} == {59}
    monkeypatch.setattr(S.R, "DENSE_ROWS", 12)
    assert S.R.crowded_groups(S.R.prepare(df, cfg), ["account_id"], cfg).isEmpty()

    def joined(*_):
        raise AssertionError("no account is large")
    monkeypatch.setattr(S, "joined_statistics", joined)
    assert of() == want


def test_crowded_windows_are_found_across_cells(spark, monkeypatch):
    """Thirteen distinct rows of one window make a group crowded wherever the window lies; groups without an account too."""
    monkeypatch.setattr(S.R, "DENSE_ROWS", 12)
    cfg = Config.fixture()
    for start in range(0, 4 * 86400, 40_000):
        rows = [{"account_id": None, "seq": i, "ts": at(start + i * 3600), "amount": 100, "balance": 900} for i in range(13)]
        got = S.R.crowded_groups(S.R.prepare(txn_rows(spark, rows), cfg), ["account_id"], cfg).collect()
        assert [r.account_id for r in got] == [None]


def test_episodes_shuffle_narrow_rows_once(spark):
    """One shuffle of the flagged rows for the sessions and one of the episodes, without the flags' texts."""
    df = cut_lineage(S.score_transactions(txn_rows(spark, [{"ts": at(s), "amount": 10 + s, "balance": 100} for s in range(0, 300, 60)])))
    plan = RP.episodes(df)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Exchange hashpartitioning") == 2
    below = text[text.index("Exchange hashpartitioning(__place"):].split("\n")
    carried = next(line for line in below if "Project" in line)
    assert "array_contains(rule_flags" in carried and not any(line.strip(" :+-*").startswith("Exchange") for line in below[1:])

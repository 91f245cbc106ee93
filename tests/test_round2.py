"""Edges: null times, tolerances, statement order, stage tables, parsers, late stream rows."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import T0, at, txn_rows
from ledgerlens import session
from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions import windows as W
from ledgerlens.operators import rules as R
from ledgerlens.operators import standardize as ST
from ledgerlens.operators import textlines as TL
from ledgerlens.sources import statements as SS
from ledgerlens.streaming.stream import _velocity_state


def test_rows_without_time_are_kept(spark):
    df = spark.createDataFrame([(1, 1, T0, 5), (1, 2, None, 7), (1, 3, at(90_000), 1), (1, 4, None, 2), (2, 5, None, 3)],
                               "k int, seq int, ts timestamp, v int")
    run = W.bucketed_running_sum(df, ["k"], "ts", "seq", "v", "total")
    assert {(r["seq"], r["total"]) for r in run.collect()} == {(1, 5), (3, 6), (2, 13), (4, 15), (5, 3)}
    ses = W.bucketed_sessions(df, ["k"], "ts", "seq", 3600 * 1_000_000, "s")
    assert {(r["seq"], r["s"]) for r in ses.collect()} == {(1, 1), (3, 2), (2, 2), (4, 2), (5, 1)}
    prev = W.bucketed_prev(df, ["k"], "ts", "seq", ["seq"])
    assert {(r["seq"], r["prev_seq"]) for r in prev.collect()} == {(1, None), (3, 1), (2, 3), (4, 2), (5, None)}


@pytest.mark.parametrize("tol", [0.0, 0.05, 0.6, 1.0, 1.5, 3.0])
def test_repeat_tolerances(spark, tol):
    amounts = [0, 0, 0.01, 1, 1.04, 2, 2.5, 4.9, 100, 104, 105.1, 250, -3, -1, 399.5, 100]
    rows = [dict(seq=i, ts=at(i * 60), amount=a) for i, a in enumerate(amounts)]
    cfg = Config(repeated_key="merchant", repeated_tolerance=tol)
    got = {r["seq"]: r["repeat_partners"] for r in R.repeated_counts(txn_rows(spark, rows), cfg).collect()}
    want = {i: sum((abs(a - b) / abs(a) <= tol if a else b == 0) for j, b in enumerate(amounts) if j != i)
            for i, a in enumerate(amounts)}
    assert {i: got.get(i, 0) for i in want} == want
    with pytest.raises(ValueError):
        R.repeated_counts(txn_rows(spark, rows), Config(repeated_tolerance=-0.1))


def test_statement_order_does_not_depend_on_splits(spark, tmp_path):
    for a in range(3):
        pd.DataFrame({"amount": [f"{a}.{i:04d}" for i in range(4000)], "note": ["x" * 40] * 4000}).to_csv(
            tmp_path / f"acc{a}.csv", index=False)
    seen = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = SS.read_statements(spark, str(tmp_path)).select("account_id", "seq", "amount").collect()
        seen.append({(r["account_id"], r["seq"]): r["amount"] for r in rows})
        sample = SS.load_training(spark, str(tmp_path), sample=50).select("amount").collect()
        seen.append({r["amount"] for r in sample})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[2] and seen[1] == seen[3] and len(seen[1]) == 50
    assert seen[0][("acc1", 3999)] == "1.3999" and len(seen[0]) == 12_000


def test_stage_table_follows_its_input(spark, tmp_path):
    folder = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(folder)
    build = lambda: spark.read.parquet(folder)
    assert session.materialized(spark, "probe", [folder], build).count() == 10
    spark.range(5).write.mode("append").parquet(folder)
    os.utime(folder, (0, 0))                       # the folder's own time says nothing
    assert session.materialized(spark, "probe", [folder], build).count() == 15
    with pytest.raises(Exception):
        session.materialized(spark, "probe", [str(tmp_path / "missing.parquet")], build)


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Option:
        def isDefined(self):
            return False

    class Jsc:
        def sc(self):
            return type("S", (), {"getCheckpointDir": lambda self: Option()})()

    spark = type("Spark", (), {"conf": Conf(), "sparkContext": type("Ctx", (), {"_jsc": Jsc(), "master": "yarn"})()})()
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(spark)


def test_money_dates_and_purchase(spark):
    df = spark.createDataFrame([(1.2345678e7,), (-5.5,), (None,), (0.0,)], "x double")
    assert [r[0] for r in df.select(C.money(F.col("x"))).collect()] == [12345678.0, -5.5, 0.0, 0.0]
    df = spark.createDataFrame([("1,234.50",), ("$ -7",), ("Rs. 1e5x",), ("3E2",), ("abc",), ("NaN",)], "x string")
    assert [r[0] for r in df.select(C.money(F.col("x"))).collect()] == [1234.5, -7.0, 0.15, 300.0, 0.0, 0.0]
    assert df.select(C.money(F.col("x"), True)).collect()[1][0] == 7.0
    dates = spark.createDataFrame([("12:30",), ("12:30:10",), ("T12:30",), ("2024-03-05",), ("05-03-2024",), (None,), ("",)], "x string")
    assert [str(r[0]) for r in dates.select(ST.std_date(F.col("x"))).collect()] == ["None"] * 3 + ["2024-03-05"] * 2 + ["None"] * 2
    assert [str(r[0]) for r in dates.select(TL.parse_dates_day_first(F.col("x"))).collect()] == \
        ["None"] * 3 + ["2024-03-05"] * 2 + ["None"] * 2
    p = spark.createDataFrame([("PURCHASE FOO\nBAR  X",), ("PURCHASE FOO BAR  X",)], "x string")
    assert [r[0] for r in p.select(TL.layout_merchant(F.col("x"), F.lit("PURCHASE"))).collect()][1] == "FOO BAR"
    assert "BAR" not in p.select(TL.layout_merchant(F.col("x"), F.lit("PURCHASE"))).collect()[0][0]


class State:
    """The part of GroupState that the velocity function uses."""
    hasTimedOut = False

    def __init__(self):
        self.value, self.timeout, self.exists = None, None, False

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value, self.exists = v, True

    def remove(self):
        self.value, self.exists = None, False

    def setTimeoutTimestamp(self, t):
        self.timeout = t

    def getCurrentWatermarkMs(self):
        return 0


def test_velocity_state_late_rows_and_timeout():
    fn, state = _velocity_state(3_600_000), State()
    frame = lambda *s: iter([pd.DataFrame({"ts": pd.to_datetime([at(x) for x in s]), "seq": range(len(s))})])
    first = list(fn((1,), frame(0, 30), state))[0]
    assert first["score_velocity"].tolist() == [0.0, 1.0] and state.timeout is not None
    late = list(fn((1,), frame(-100, 10, 90), state))[0]
    assert late["gap_seconds"].isna().tolist() == [True, True, False] and late["gap_seconds"].iloc[2] == 60
    state.hasTimedOut = True
    assert list(fn((1,), iter([]), state)) == [] and not state.exists


def test_quantiles_and_modes_equal_the_builtin(spark):
    import random
    from ledgerlens.functions.quantiles import grouped_mode, grouped_quantiles
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), round(rnd.choice([1, -1]) * 10 ** rnd.uniform(-3, 7), 2)) for _ in range(3000)]
    rows += [("c", None), ("c", None), ("d", 5.0), ("e", 0.0), ("e", 0.0), ("e", 1e-300), ("f", 2.0), ("f", None)] + [("a", 7.0)] * 500
    df = spark.createDataFrame(rows, "g string, x double")
    qs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r["g"]: tuple(r[n] for n in qs) for r in grouped_quantiles(df, ["g"], F.col("x"), qs).collect()}
    want = {r["g"]: tuple(r[n] for n in qs) for r in df.groupBy("g").agg(*[F.percentile("x", q).alias(n) for n, q in qs.items()]).collect()}
    assert got == want
    whole = grouped_quantiles(df, [], F.col("x"), {"m": 0.5}).collect()
    assert whole[0]["m"] == df.agg(F.median("x")).first()[0]
    m = df.withColumn("x", F.round("x", -5))
    got = {r["g"]: r["m"] for r in grouped_mode(m, ["g"], F.col("x"), "m").collect()}
    assert got == {r["g"]: r["m"] for r in m.groupBy("g").agg(F.mode("x", True).alias("m")).collect()}
    # no task ranks the values of a whole group
    plan = grouped_quantiles(df, ["g"], F.col("x"), qs)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_hot_buckets_are_cut(spark, monkeypatch):
    """One account and day with a third of all rows, half of them at one instant."""
    from pyspark.sql import Window
    monkeypatch.setattr(W, "HOT_ROWS", 50)
    rows = [(1, i, at(0) if i % 2 else at(i % 700), i % 13) for i in range(1500)] + \
           [(k, 10_000 + k * 7 + j, at(j * 40_000), 1) for k in range(2, 60) for j in range(7)] + \
           [(1, 50_000 + i, None, 2) for i in range(200)] + [(None, 60_000 + i, at(i), 2) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, seq int, ts timestamp, v int").repartition(5)
    order = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_last(), "seq")
    cut = W.ordered(df, ["k"], "ts", "seq", W.time_bucket("ts", 86400))
    most = cut.where("k = 1").groupBy("__bkt").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= 150 and most[1] > 20
    # the buckets rise with the order
    falls = cut.withColumn("before", F.lag("__bkt").over(order)).where("before > __bkt")
    assert falls.count() == 0
    some = df
    want = some.withColumn("t", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("p", F.lag("seq").over(order))
    want = {r["seq"]: (r["t"], r["p"]) for r in want.collect()}
    total = {r["seq"]: r["t"] for r in W.bucketed_running_sum(some, ["k"], "ts", "seq", "v", "t").collect()}
    prev = {r["seq"]: r["prev_seq"] for r in W.bucketed_prev(some, ["k"], "ts", "seq", ["seq"]).collect()}
    assert {s: (total[s], prev[s]) for s in total} == want
    gap = 60 * 1_000_000
    ses = {r["seq"]: r["s"] for r in W.bucketed_sessions(some, ["k"], "ts", "seq", gap, "s").collect()}
    new = some.withColumn("n", F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > gap).cast("int"), F.lit(0)))
    want = {r["seq"]: r["s"] + 1 for r in new.withColumn("s", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).collect()}
    assert ses == want


def test_single_statement_scope(spark):
    """by=() gives what one account with all the rows gives, and keeps the rows' own accounts."""
    from ledgerlens.operators import analytics as A
    from ledgerlens.operators import scoring as S
    import random
    rnd = random.Random(3)
    rows = [dict(account_id=1 + i % 3, seq=i, ts=at(i * 4000), amount=round(rnd.uniform(1, 60_000), 2), balance=1000,
                 debit_credit=rnd.choice(["Debit", "Credit"]), merchant=f"M{i % 4}") for i in range(120)]
    df = txn_rows(spark, rows)
    one = df.withColumn("account_id", F.lit(5).cast("long"))
    for op in (lambda d, by: S.score_transactions(d, Config.fixture(), by=by).select("seq", "final_risk_score", "rule_score"),
               lambda d, by: R.rule_engine(d, Config.fixture(), by=by).select("seq", "rule_flags", "rule_score")):
        assert sorted(op(df, ()).collect()) == sorted(op(one, ("account_id",)).collect())
    scored = S.score_transactions(df, Config.fixture(), by=())
    assert {(r["seq"], r["account_id"]) for r in scored.select("seq", "account_id").collect()} == {(i, 1 + i % 3) for i in range(120)}
    for op in (A.spending_trends, A.insights, A.kpis, A.summary_statistics):
        whole, single = op(df, by=()).collect(), op(one).drop("account_id").collect()
        assert whole == single and len(whole) == 1

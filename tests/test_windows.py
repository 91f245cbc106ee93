"""Invariants of the skew-safe ordering helpers against plain windows / brute force."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.windows import bucketed_prev, bucketed_running_sum, range_count


def _data(spark, n=400, accounts=3, seed=7):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(accounts), i, 1_700_000_000_000_000 + rnd.randrange(0, 5 * 86400) * 1_000_000, rnd.randrange(1, 50))
            for i in range(n)]
    # a few exact timestamp ties
    rows += [(0, n + k, rows[k][2], 3) for k in range(5)]
    df = spark.createDataFrame(rows, "a long, seq long, us long, v long")
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_running_sum_equals_window(spark):
    df = _data(spark)
    got = bucketed_running_sum(df, ["a"], "ts", "seq", "v", "rs", bucket_seconds=3600)
    w = Window.partitionBy("a").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("rs", F.sum("v").over(w))
    assert sorted(got.select("seq", "rs").collect()) == sorted(exp.select("seq", "rs").collect())


def test_prev_equals_lag(spark):
    df = _data(spark)
    got = bucketed_prev(df, ["a"], "ts", "seq", ["v", "seq"], prefix="p_", bucket_seconds=7200)
    w = Window.partitionBy("a").orderBy("ts", "seq")
    exp = df.withColumn("p_v", F.lag("v").over(w)).withColumn("p_seq", F.lag("seq").over(w))
    assert sorted(got.select("seq", "p_v", "p_seq").collect()) == sorted(exp.select("seq", "p_v", "p_seq").collect())


def test_range_count_equals_brute_force(spark):
    df = _data(spark, n=300)
    h = 1800 * 1_000_000
    got = {(r.a, r.seq): r.c for r in range_count(df, ["a"], "ts", "seq", h, h, "c", bucket_seconds=3600).collect()}
    rows = df.select("a", "seq", "us").collect()
    for r in rows:
        exp = sum(1 for s in rows if s.a == r.a and abs(s.us - r.us) <= h)
        assert got[(r.a, r.seq)] == exp


def test_sessions_equal_lag_cumsum(spark):
    from ledgerlens.functions.windows import bucketed_sessions
    df = _data(spark, n=500)
    gap = 5 * 3600 * 1_000_000
    got = bucketed_sessions(df, ["a"], "ts", "seq", gap, "sid", bucket_seconds=7200)
    w = Window.partitionBy("a").orderBy("ts", "seq")
    new = F.when(F.lag("us").over(w).isNotNull() & (F.col("us") - F.lag("us").over(w) > gap), 1).otherwise(0)
    exp = df.withColumn("n", new).withColumn("sid", 1 + F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(got.select("seq", "sid").collect()) == sorted(exp.select("seq", F.col("sid").cast("int")).collect())

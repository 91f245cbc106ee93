"""The scored table's shuffles: rows stay where a window has put them, small keys need no second pass."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import at, txn_rows
from ledgerlens.functions import windows as W
from ledgerlens.operators import scoring as S


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_stay_where_the_window_has_put_them(sorted_joins):
    df = sorted_joins.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"),
                                        F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    for out in (W.bucketed_running_sum(df, ["k"], "ts", "seq", "seq", "s"), W.bucketed_prev(df, ["k"], "ts", "seq", ["seq"]),
                W.bucketed_sessions(df, ["k"], "ts", "seq", 1, "s")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        # a null-safe join shuffles by the keys with a value put for null, so all rows once more
        assert "hashpartitioning(coalesce(" not in plan and "hashpartitioning(__place" in plan


def test_row_sides_need_no_full_join(spark):
    df = txn_rows(spark, [{"ts": at(s), "amount": 10 + s, "balance": 100} for s in range(0, 300, 60)])
    assert "FullOuter" not in S.score_transactions(df)._jdf.queryExecution().optimizedPlan().toString()


def test_null_keys_keep_their_order(spark):
    rows = [(None, i, dt.datetime(2024, 1, 1 + i % 3), float(i)) for i in range(9)] + [(1, i, None, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, seq long, ts timestamp, v double")
    got = {(r.k, r.seq): r.s for r in W.bucketed_running_sum(df, ["k"], "ts", "seq", "v", "s").collect()}
    for k in (None, 1):
        some = sorted([r for r in rows if r[0] == k], key=lambda r: (r[2] or dt.datetime(1, 1, 1), r[1]))
        for i, r in enumerate(some):
            assert got[k, r[1]] == sum(x[3] for x in some[:i + 1])
    prev = {(r.k, r.seq): r.prev_v for r in W.bucketed_prev(df, ["k"], "ts", "seq", ["v"]).collect()}
    order = sorted([r for r in rows if r[0] is None], key=lambda r: (r[2], r[1]))
    assert [prev[None, r[1]] for r in order] == [None, *[r[3] for r in order[:-1]]]


def test_range_sums_agree_in_hot_and_in_small_buckets(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 2, None]), draw.randrange(0, 400_000, 100), draw.choice([1, 2, None])) for _ in range(400)]
    df = (spark.createDataFrame([(k, i, t, w) for i, (k, t, w) in enumerate(rows)], "k long, seq long, t long, w int")
          .withColumn("ts", F.timestamp_seconds("t")))
    for hot in (0, 10, 1_000_000):
        got = {r.seq: (r.n, r.s) for r in W.range_sums(df, ["k"], "ts", "seq", 3_000_000_000, 1_000_000_000,
                                                       {"n": F.lit(1), "s": F.col("w")}, 86400, F.col("seq") % 2 == 0, hot).collect()}
        assert set(got) == set(range(0, 400, 2))
        for i, (n, s) in got.items():
            near = [w for k, t, w in rows if k == rows[i][0] and -3000 <= t - rows[i][1] <= 1000]
            assert n == len(near), (hot, i)
            # growing frames: a frame without a number counts as none only below the window
            assert (s or 0) == sum(w or 0 for w in near), (hot, i)


def test_training_parts_follow_cores_and_rows():
    from ledgerlens.operators import ml as ML
    assert [ML.training_parts(n, 12) for n in (0, 9_000, 80_000, 4_800_000, 28_800_000)] == [1, 1, 8, 24, 144]


def test_the_training_set_is_dealt_evenly_and_the_forest_keeps_its_place(spark):
    from ledgerlens.operators import ml as ML
    rows = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 10 == 0).cast("int").alias(ML.LABEL),
                                    *[(F.col("id") * (i + 7) % 101).cast("double").alias(c) for i, c in enumerate(ML.FEATURE_COLS)])
    train, test = ML.prepare(rows.coalesce(1), rows_per_part=500)
    sizes = train.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert len(sizes) == 5 and sum(sizes) == 2400 and max(sizes) < 600 and test.count() == 600
    rf = ML.train_rf(train, ML.MLConfig(rf_trees=3, rf_depth=3))
    assert rf.stages[-1].getCacheNodeIds()


def test_the_test_part_is_scored_once(spark):
    from ledgerlens.operators import ml as ML
    cfg = ML.MLConfig(rf_trees=3, rf_depth=3, iso_trees=5)
    rows = spark.range(2000).select(F.col("id").alias("seq"), (F.col("id") % 10 == 0).cast("int").alias(ML.LABEL),
                                    *[(F.col("id") * (i + 7) % 101).cast("double").alias(c) for i, c in enumerate(ML.FEATURE_COLS)])
    train, test = ML.prepare(rows, cfg)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(y):
        seen.add(1)
        return y
    metrics = ML.evaluate(ML.FraudModels(rf=ML.train_rf(train, cfg), iso=ML.fit_isolation(train, cfg), cfg=cfg),
                          test.withColumn(ML.LABEL, counted.asNondeterministic()(ML.LABEL)))
    assert {r.model: r.tp + r.fp + r.fn + r.tn for r in metrics.collect()} == {"random_forest": 400, "isolation_forest": 400}
    assert seen.value == 400

"""The burst rule on a stream: equal to a plain count in several micro-batches, state bounded by a bucket."""
import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.plans.stream_run import settings
from ledgerlens.streaming import stream as ST

T0 = dt.datetime(2024, 1, 1)
CFG = Config.fixture()


def _events(spark, path, rows):
    d = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=t), a) for i, t, a in rows], "event_id long, ts timestamp, user_id long")
    d.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"),
             F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")).coalesce(1).write.mode("append").parquet(path)


def _run(spark, batches, **kw):
    """The rows that came out, and the most events that one state held after a batch."""
    root = tempfile.mkdtemp(prefix="bursts-")
    _events(spark, f"{root}/in", batches[0])
    src = spark.readStream.schema(ST.EVENTS_SCHEMA).parquet(f"{root}/in")
    with settings(spark, ST.STATE_STORE):
        q = (ST.st_rapid(ST.txn_stream(src), CFG, **kw).writeStream.outputMode("append").format("parquet")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").start())
        widest = 0
        try:
            for i, rows in enumerate(batches):
                if i:
                    _events(spark, f"{root}/in", rows)
                q.processAllAvailable()
                state = (spark.read.format("statestore").option("stateVarName", "events").load(f"{root}/ckpt")
                         .groupBy("key").count())
                widest = max(widest, state.agg(F.max("count")).first()[0] or 0)
        finally:
            q.stop()
    out = spark.read.schema("account_id long, seq long, rapid_count long").parquet(f"{root}/out")
    return {(r[0], r[1]): r[2] for r in out.collect()}, widest


def _plain(rows):
    out = {}
    for i, t, a in rows:
        n = sum(1 for _, u, b in rows if b == a and abs(u - t) <= 300)
        if n >= CFG.rapid_burst_threshold:
            out[a, i] = n
    return out


def test_bursts_over_batches_and_bucket_borders(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 895, 900, 905, 1800, 2100, 2400, 5000]) + rnd.randint(0, 8), rnd.randint(1, 4)) for i in range(300)]
    rows += [(1000, 600, 9), (1001, 900, 9), (1002, 1200, 9), (1003, 1501, 9)]     # exactly half a window apart
    rows.sort(key=lambda r: r[1])
    batches = rows[:150], rows[150:], [(-1, 10 ** 7, 0)], [(-2, 2 * 10 ** 7, 0)]
    got, _ = _run(spark, [list(b) for b in batches], bucket_seconds=900, groups=2)
    assert got == _plain(rows) and got


def test_state_does_not_grow_with_the_account(spark):
    """One account, an event every 30 seconds: a state holds a bucket's 15 + 2 x 5 minutes, however many come."""
    rows = [(i, 30 * i, 1) for i in range(4000)]
    got, widest = _run(spark, [rows[:2000], rows[2000:], [(-1, 10 ** 8, 0)], [(-2, 2 * 10 ** 8, 0)]], bucket_seconds=900)
    assert widest <= (900 + 600) // 30 + 1
    assert got == ({(1, i): min(i, 10) + min(3999 - i, 10) + 1 for i in range(4000)
                    if min(i, 10) + min(3999 - i, 10) + 1 >= CFG.rapid_burst_threshold})

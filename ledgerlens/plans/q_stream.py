"""Registered streaming queries: each runs a Structured
Streaming query over the events table to completion and returns its sink
table; the oracle is the batch result of the same rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.plans.registry import register
from ledgerlens.plans.sql_rules import rule_ctes
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.plans.stream_run import StreamRun
from ledgerlens.sources.tables import txn
from ledgerlens.streaming import stream as ST
from ledgerlens.streaming.baselines import Baselines, score_days, score_rows

FIX = Config.fixture()
DEF = Config()


def _run(spark, sf_dir, name, fn, mode="append", conf=None):
    return StreamRun(spark, sf_dir, name).run(fn, mode, conf=conf)


@register("st_daily_volume", with_txn("""
SELECT account_id, strftime(date, '%Y-%m-%d') AS date, CAST(sum(amount) AS DOUBLE) AS total_amount, count(amount) AS count
FROM txn GROUP BY account_id, date"""))
def st_daily_volume(spark, sf_dir):
    """Tumbling daily totals per account on a stream (watermark-closed)."""
    return _run(spark, sf_dir, "daily", ST.st_daily_volume)


@register("st_stateless_rules", with_txn(f"""
SELECT account_id, seq, CAST(amount AS DOUBLE) AS amount,
       amount >= {DEF.late_night_min_amount} AND (hour(ts) >= 23 OR hour(ts) < 5) AS late_night,
       amount > 20000 AS high_value, amount >= 9000 AND amount <= 9999 AS near_threshold
FROM txn WHERE (amount >= {DEF.late_night_min_amount} AND (hour(ts) >= 23 OR hour(ts) < 5)) OR amount > 20000
   OR (amount >= 9000 AND amount <= 9999)"""))
def st_stateless_rules(spark, sf_dir):
    """Row-local rules evaluated on the stream."""
    return _run(spark, sf_dir, "stateless", lambda s: ST.st_stateless_rules(s, DEF))


@register("st_dedupe", with_txn("SELECT account_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM txn"))
def st_dedupe(spark, sf_dir):
    """Transaction-id dedupe within the watermark (ids are unique here)."""
    return _run(spark, sf_dir, "dedupe", ST.st_dedupe)


@register("st_dedupe_copies", with_txn("SELECT account_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM txn"))
def st_dedupe_copies(spark, sf_dir):
    """Dedupe of a stream in which every fifth transaction comes twice."""
    return _run(spark, sf_dir, "dedupe-copies", lambda s: ST.st_dedupe(s.unionByName(s.where(F.col("seq") % 5 == 0))))


@register("st_structuring", with_txn("""
SELECT account_id, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS near_count,
       CAST(sum(amount) AS DOUBLE) AS near_total
FROM (SELECT account_id, amount, CAST(date AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS ws
      FROM txn, range(0, 6) r(k) WHERE amount >= 9000 AND amount <= 9999)
GROUP BY account_id, ws"""))
def st_structuring(spark, sf_dir):
    """Sliding 6-day / 1-day windows of near-threshold amounts per account."""
    return _run(spark, sf_dir, "structuring", ST.st_structuring)


@register("st_episodes", with_txn(f"""
SELECT account_id, count(*) AS txn_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM (SELECT *, sum(nw) OVER (PARTITION BY account_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq) IS NULL
                            OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq)) >= 86400000000
                           THEN 1 ELSE 0 END AS nw
            FROM txn WHERE amount >= {DEF.late_night_min_amount} AND (hour(ts) >= 23 OR hour(ts) < 5)))
GROUP BY account_id, sid"""))
def st_episodes(spark, sf_dir):
    """24-hour sessions of late-night-flagged rows on a stream."""
    return _run(spark, sf_dir, "episodes", lambda s: ST.st_episodes(s, DEF))


@register("st_rapid", with_txn(f"""
SELECT account_id, seq, rapid_count FROM (
  SELECT account_id, seq, count(*) OVER (PARTITION BY account_id ORDER BY ts
         RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND INTERVAL 300 SECONDS FOLLOWING) AS rapid_count FROM txn)
WHERE rapid_count >= {FIX.rapid_burst_threshold}"""))
def st_rapid(spark, sf_dir):
    """Burst rule with list state per group of accounts and time bucket and event-time timers (fixture
    thresholds); equals the batch rule."""
    return _run(spark, sf_dir, "rapid", lambda s: ST.st_rapid(s, FIX), conf=ST.STATE_STORE)


@register("st_velocity", with_txn("""
SELECT account_id, seq, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq))) / 1e6 AS gap_seconds,
       CAST(CASE WHEN coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq))) / 1e6, 3600.0) < 60 THEN 1.0
            WHEN coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq))) / 1e6, 3600.0) < 300 THEN 0.7
            WHEN coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq))) / 1e6, 3600.0) < 900 THEN 0.4
            WHEN coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts, seq))) / 1e6, 3600.0) < 3600 THEN 0.2
            ELSE 0.0 END AS DOUBLE) AS score_velocity
FROM txn"""))
def st_velocity(spark, sf_dir):
    """Velocity score from the gap to the previous event, kept as state."""
    return _run(spark, sf_dir, "velocity", ST.st_velocity)


def _with_baselines(spark, sf_dir, name, fn, score):
    """One version from the whole table, then the table as a stream against it."""
    run = StreamRun(spark, sf_dir, name)
    baselines = Baselines(spark, f"{run.root}/baselines", DEF)
    baselines.publish(txn(spark, sf_dir, DEF), 1)
    return run.run(fn, per_batch=lambda batch, i: score(batch, baselines, baselines.of_batch(f"{run.root}/applied", i)))


@register("st_baseline_rules", with_txn("""
SELECT e.account_id, seq, CAST(amount AS DOUBLE) AS amount, channel, channel_median, r_high_value,
       CAST(coalesce(CAST(amount AS DOUBLE) > p95, false) AS INTEGER) AS is_large_amount, CAST(1 AS BIGINT) AS version
FROM ev e LEFT JOIN (SELECT account_id, quantile_cont(CAST(coalesce(amount, 0) AS DOUBLE), 0.95) AS p95 FROM txn GROUP BY account_id) s
  ON e.account_id = s.account_id
WHERE r_high_value OR coalesce(CAST(amount AS DOUBLE) > p95, false)""", *rule_ctes(DEF)))
def st_baseline_rules(spark, sf_dir):
    """High value and large amount on a stream, against a published baseline version; equals the batch rules."""
    return _with_baselines(spark, sf_dir, "baseline-rules", lambda s: s, score_rows)


@register("st_baseline_spikes", with_txn("""
SELECT account_id, strftime(date, '%Y-%m-%d') AS date, CAST(day_total AS DOUBLE) AS day_total, median_day,
       CAST(1 AS BIGINT) AS version
FROM dayf WHERE spike_day""", *rule_ctes(DEF)))
def st_baseline_spikes(spark, sf_dir):
    """Spike days among the day totals that the watermark closes, against a published baseline version."""
    return _with_baselines(spark, sf_dir, "baseline-spikes", ST.st_daily_volume, score_days)

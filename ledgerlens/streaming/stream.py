"""Structured Streaming re-aims of batch operators.

Source: a file stream of the ``events`` schema mapped statelessly to
transaction columns (no running balance on a stream).  Every stateful query
carries a watermark.  ``st_rapid`` keeps list states per group of accounts and time bucket
(``transformWithStateInPandas``), whose event-time timers decide a bucket once the watermark
has passed all that can count for it; ``st_velocity`` keeps one row per account
with ``applyInPandasWithState`` and a timeout.

The operators take and return streaming DataFrames; how they are fed and
where they are written is the caller's business.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.config import Config
from ledgerlens.sources.tables import MONEY, _mode_expr

# the state store that list states and timers run on; set by whoever starts the query
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def txn_stream(raw: DataFrame) -> DataFrame:
    """Stateless events -> transaction columns (same mapping as the batch view)."""
    ts = F.col("ts").cast("timestamp")
    mode = _mode_expr("event_type")
    merchant = F.concat(F.lit("M"), F.get_json_object("props", "$.k"))
    return raw.select(
        F.col("user_id").alias("account_id"), F.col("event_id").alias("seq"), ts.alias("ts"),
        F.to_date(ts).alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"),
        F.when(F.col("event_type") == "signup", "Credit").otherwise("Debit").alias("debit_credit"),
        F.round(F.col("value") * 100).cast(MONEY).alias("amount"), mode.alias("mode"),
        merchant.alias("merchant"), F.concat(mode, F.lit("/"), merchant).alias("narration"))


# ----------------------------------------------------------------- operators
def st_daily_volume(s: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tumbling day totals per account, emitted when the watermark closes the day."""
    g = (s.withWatermark("ts", watermark).groupBy("account_id", F.window("ts", "1 day"))
         .agg(F.sum("amount").alias("total_amount"), F.count("amount").alias("count")))
    return g.select("account_id", F.to_date(F.col("window.start")).alias("date"), "total_amount", "count")


def st_stateless_rules(s: DataFrame, cfg: Config = Config(), threshold: float = 20000.0) -> DataFrame:
    """Row-local flags on the stream: late night, portfolio high value, near threshold."""
    h = F.hour("ts")
    a = F.col("amount")
    flags = {"late_night": (a >= cfg.late_night_min_amount) & ((h >= cfg.late_night_start_hour) | (h < cfg.late_night_end_hour)),
             "high_value": a > threshold, "near_threshold": (a >= 9000) & (a <= 9999)}
    d = s.withColumns({k: v for k, v in flags.items()})
    return d.where(F.col("late_night") | F.col("high_value") | F.col("near_threshold")).select(
        "account_id", "seq", "amount", "late_night", "high_value", "near_threshold")


def st_dedupe(s: DataFrame, delay: str = "1 hour") -> DataFrame:
    return s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["seq"]).select("account_id", "seq", "ts")


def st_structuring(s: DataFrame, window: str = "6 days", slide: str = "1 day") -> DataFrame:
    """Sliding-window counts / sums of near-threshold amounts per account."""
    near = s.withWatermark("ts", "1 day").where((F.col("amount") >= 9000) & (F.col("amount") <= 9999))
    g = (near.groupBy("account_id", F.window("ts", window, slide))
         .agg(F.count(F.lit(1)).alias("near_count"), F.sum("amount").alias("near_total")))
    return g.select("account_id", F.col("window.start").alias("window_start"), "near_count", "near_total")


def st_episodes(s: DataFrame, cfg: Config = Config(), gap: str = "24 hours") -> DataFrame:
    """Sessions of late-night-flagged rows per account (session window)."""
    h = F.hour("ts")
    flagged = s.withWatermark("ts", "1 day").where(
        (F.col("amount") >= cfg.late_night_min_amount) & ((h >= cfg.late_night_start_hour) | (h < cfg.late_night_end_hour)))
    g = (flagged.groupBy("account_id", F.session_window("ts", gap))
         .agg(F.count(F.lit(1)).alias("txn_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    return g.select("account_id", "txn_count", "first_ts", "last_ts")


def _us(col: pd.Series) -> list[int]:
    return (pd.to_datetime(col).astype("int64") // 1000).tolist()


class _Bursts(StatefulProcessor):
    """The events of one (group of accounts, time bucket) and of ``half_us`` on both sides of the bucket.

    They are a list state: an event is appended without reading those before it, and read back one by one into
    24 bytes.  One timer, at the end of the bucket plus the half window, decides all rows of the bucket and clears
    the state: no event that could still count for them comes after it, for it would be behind the watermark."""

    def __init__(self, width_us: int, half_us: int, threshold: int):
        self.width_us, self.half_us, self.threshold = width_us, half_us, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "account long, us long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = (int(key[1]) + 1) * self.width_us + self.half_us
        # the same timer each time; ahead of the watermark at least, else it would not be heard
        self.handle.registerTimer(max(due // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        for pdf in rows:
            self.events.appendList(list(zip(pdf["account_id"].tolist(), _us(pdf["ts"]), pdf["seq"].tolist())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ev = np.fromiter((tuple(e) for e in self.events.get()), dtype=[("account", "i8"), ("us", "i8"), ("seq", "i8")])
        self.events.clear()
        accounts, which = np.unique(ev["account"], return_inverse=True)
        # accounts side by side on one line, further apart than any window reaches
        start = int(key[1]) * self.width_us - self.half_us
        at = which * (self.width_us + 4 * self.half_us + 1) + (ev["us"] - start)
        line, own = np.sort(at), ev["us"] // self.width_us == int(key[1])
        n = (np.searchsorted(line, at[own] + self.half_us, "right") - np.searchsorted(line, at[own] - self.half_us, "left"))
        hit = n >= self.threshold
        if hit.any():
            yield pd.DataFrame({"account_id": ev["account"][own][hit], "seq": ev["seq"][own][hit], "rapid_count": n[hit]})

    def close(self) -> None:
        pass


def st_rapid(s: DataFrame, cfg: Config = Config(), delay: str = "10 minutes", bucket_seconds: int = 21600,
             groups: int = 16) -> DataFrame:
    """Burst rule on a stream, exact, without a look-ahead cap.

    State is kept per group of accounts (hash modulo ``groups``) and time bucket of ``bucket_seconds`` (at
    least the window).  An event goes to its own bucket and, as a neighbour, to the one that its half window
    reaches into; a bucket is decided once the watermark passes its end plus the half window.  So what a timer
    reads grows with the events of a bucket, not with the past of an account.  Each state costs some
    milliseconds whatever it holds: few wide ones suit thin streams, many narrow ones (``groups`` of several
    per core, minutes) thick ones.  Rows without a time of day, an account or a number take no part.

    The query must start with the state store ``STATE_STORE``."""
    half_us = int(cfg.rapid_window_minutes * 60 * 1_000_000 / 2)
    width = max(int(bucket_seconds) * 1_000_000, 2 * half_us)
    us = F.unix_micros("ts")
    bucket = lambda shift: F.floor((us + F.lit(shift)) / F.lit(width)).cast("long")
    d = (s.where((F.length("time") > 0) & F.col("account_id").isNotNull() & F.col("seq").isNotNull())
         .select(F.col("account_id").cast("long").alias("account_id"), F.col("seq").cast("long").alias("seq"), "ts")
         .withWatermark("ts", delay)
         .withColumns({"accounts": F.pmod(F.xxhash64("account_id"), F.lit(groups)),
                       "bucket": F.explode(F.sequence(bucket(-half_us), bucket(half_us)))}))
    return d.groupBy("accounts", "bucket").transformWithStateInPandas(
        _Bursts(width, half_us, cfg.rapid_burst_threshold), "account_id long, seq long, rapid_count long",
        outputMode="Append", timeMode="EventTime")


def _velocity_state(keep_ms: int):
    """State per account: the latest event seen.  It is dropped once the watermark is
    ``keep_ms`` past it; an event older than the latest one has no gap (score 0)."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frames = list(pdfs)
        if not frames:
            return
        rows = pd.concat(frames)
        rows = rows.assign(us=_us(rows["ts"])).sort_values(["us", "seq"])
        before = rows["us"].shift(1).astype("float64")
        if last is not None:
            # among the late rows and across the border: the later of the previous row and the latest event
            before = before.fillna(float(last)).clip(lower=float(last))
        gap = (rows["us"] - before) / 1e6
        gap = gap.where(gap >= 0)
        g = gap.fillna(3600.0)
        vel = [1.0 if x < 60 else 0.7 if x < 300 else 0.4 if x < 900 else 0.2 if x < 3600 else 0.0 for x in g]
        latest = max(int(rows["us"].iloc[-1]), last if last is not None else -(1 << 62))
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"account_id": [key[0]] * len(rows), "seq": rows["seq"].to_numpy(),
                            "gap_seconds": gap.to_numpy(), "score_velocity": vel})
    return fn


def st_velocity(s: DataFrame, delay: str = "10 minutes", keep_hours: int = 24) -> DataFrame:
    """Gap to the previous event of the account, kept as one row of state per account
    until the watermark is ``keep_hours`` past its latest event (longer gaps score 0 anyway).
    Rows behind the watermark are dropped; rows that are merely out of order have no gap."""
    d = s.select("account_id", "seq", "ts").withWatermark("ts", delay)
    return d.groupBy("account_id").applyInPandasWithState(
        _velocity_state(keep_hours * 3_600_000), "account_id long, seq long, gap_seconds double, score_velocity double",
        "ts long", "append", GroupStateTimeout.EventTimeTimeout)

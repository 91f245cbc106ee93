"""Feature engineering for rules and models.

Input: canonical transactions.  Output adds the 21 model features.  The only
non-local feature, ``is_large_amount`` (amount above the group's 95th
percentile), is a grouped percentile joined back -- no window over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions.quantiles import grouped_quantiles, join_groups

ACC = ("account_id",)

FEATURE_COLS = [
    "amount_f", "log_amount", "hour", "day_of_week", "is_weekend", "month", "is_night",
    "is_early_morning", "is_round_amount", "is_near_threshold", "is_large_amount",
    "balance_before", "balance_after", "balance_delta", "balance_utilization",
    "balance_zeroed_out", "amount_to_balance_ratio", "merchant_encoded", "channel_encoded",
    "txn_type_encoded", "anomaly_score_raw",
]


# fixed values: names under which exports carry a canonical column, the first present one counts
CANDIDATES = {
    "amount": ("amount", "Amount", "TransactionAmount", "amt", "Transaction Amount"),
    "ts": ("transactionTimestamp", "date", "timestamp", "Date", "TransactionDate", "Transaction Date"),
    "time": ("time", "Time"),
    "balance": ("balance_after", "balance", "currentBalance", "Balance", "AccountBalance", "Account Balance"),
    "merchant": ("merchant", "Merchant", "MerchantID", "merchant_category", "narration", "description"),
    "narration": ("narration", "description", "Merchant", "merchant"),
    "mode": ("mode", "Channel", "payment_channel", "TransactionType", "type", "transaction_type"),
    "transaction_type": ("transaction_type", "TransactionType", "txn_type", "type", "mode"),
    "debit_credit": ("debit_credit", "debit/credit", "type"),
}
# fixed values: what a column holds where no candidate is present
DEFAULTS = {"amount": 0.0, "balance": 999999.0, "time": "12:00:00", "merchant": "UNKNOWN", "narration": "UNKNOWN",
            "mode": "UNKNOWN", "debit_credit": "DEBIT"}


def resolve_columns(df: DataFrame) -> DataFrame:
    """``df`` with the columns that the features read: each the first candidate present in the table, else its
    default.  A table that has them all stays as it is.

    ``ts`` comes from the first date candidate, with the time column added where that is a bare date, and is
    null where nothing parses (hour 12, month 1, weekday 0 then).  The channel is settled before the transaction
    type, which may fall back on it.  Names are told apart as Spark does, so not by case."""
    def present(d: DataFrame, names: Sequence[str]) -> Column | None:
        return next((F.col(f"`{n}`") for n in names if n in d.columns), None)
    d = df
    if "ts" not in d.columns:
        day, clock = present(d, CANDIDATES["ts"]), present(d, CANDIDATES["time"])
        ts = F.lit(None).cast("timestamp") if day is None else F.try_to_timestamp(day.cast("string"))
        if clock is not None:
            timed = F.try_to_timestamp(F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd"), clock.cast("string")))
            ts = F.when(ts == F.date_trunc("day", ts), F.coalesce(timed, ts)).otherwise(ts)
        d = d.withColumn("ts", ts)
        if "time" not in d.columns:
            d = d.withColumn("time", F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit(DEFAULTS["time"])))
    for name in ("amount", "balance", "merchant", "narration", "mode", "transaction_type", "debit_credit"):
        if name not in d.columns:
            found = present(d, CANDIDATES[name])
            d = d.withColumn(name, F.lit(DEFAULTS[name]) if found is None else found)
    return d


def clean_money(c: Column, compat: bool) -> Column:
    """Money text/number -> double, null -> 0.  ``compat`` strips everything
    but digits and '.', which erases minus signs as the original did."""
    return C.money(c, compat)


def encode7(c: Column) -> Column:
    """crc32 of the UTF-8 text modulo 7 (stable across sessions)."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("UNK"))), F.lit(7)).cast("int")


def row_features(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Row-local part of the features (no shuffle)."""
    df = resolve_columns(df)
    amt = clean_money(F.col("amount"), cfg.compat)
    bal = clean_money(F.col("balance"), cfg.compat)
    ts = F.col("ts")
    d = df.withColumns({
        "amount_f": amt,
        "balance_after": bal,
        "hour": F.coalesce(F.hour(ts), F.lit(12)),
        "day_of_week": F.coalesce(F.weekday(ts), F.lit(0)),
        "month": F.coalesce(F.month(ts), F.lit(1)),
        "merchant": F.coalesce(F.col("merchant"), F.lit("UNKNOWN")),
        "mode": F.coalesce(F.col("mode"), F.lit("UNKNOWN")),
        "transaction_type": F.coalesce(F.col("transaction_type"), F.lit("DEBIT")),
        "debit_credit": F.coalesce(F.col("debit_credit"), F.lit("DEBIT")),
    })
    is_credit = F.upper(C.strip("debit_credit")).isin("CREDIT", "CR", "C")
    before = F.when(is_credit, F.col("balance_after") - F.col("amount_f")).otherwise(
        F.col("balance_after") + F.col("amount_f"))
    d = d.withColumn("balance_before", before)
    den = F.col("balance_before") + 1
    ratio = (F.when(den != 0, F.col("amount_f") / den)
             .when(F.col("amount_f") > 0, F.lit(10.0))
             .when(F.col("amount_f") < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0)))
    ratio = F.least(ratio, F.lit(10.0))
    h = F.col("hour")
    return d.withColumns({
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "log_amount": F.log1p("amount_f"),
        "is_night": ((h >= 23) | (h <= 5)).cast("int"),
        "is_early_morning": ((h >= 0) & (h <= 6)).cast("int"),
        "is_round_amount": (F.col("amount_f") % 1000 == 0).cast("int"),
        "is_near_threshold": ((F.col("amount_f") >= 9000) & (F.col("amount_f") <= 9999)).cast("int"),
        "balance_zeroed_out": (F.col("balance_after") <= 0).cast("int"),
        "amount_to_balance_ratio": ratio,
        "balance_utilization": ratio,
        "balance_delta": F.col("balance_before") - F.col("balance_after"),
        "merchant_encoded": encode7(F.col("merchant")),
        "channel_encoded": encode7(F.col("mode")),
        "txn_type_encoded": encode7(F.col("transaction_type")),
        "anomaly_score_raw": provided(df, "anomaly_score"),
    })


def provided(df: DataFrame, name: str) -> Column:
    """A signal that the input may carry, as a number; 0 where it does not."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0))


def amount_stats(rows: DataFrame, cfg: Config = Config(), by: Sequence[str] = ACC) -> DataFrame:
    """Per group: p95 (large-amount feature), mean and population std
    (spending-deviation score)."""
    moments = amount_moments(rows, by)
    p95 = grouped_quantiles(rows, by, F.col("amount_f"), {"amount_p95": 0.95}, cfg.quantile_accuracy)
    return join_groups(moments, p95, by)


def amount_moments(rows: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg("amount_f").alias("amount_mean"), F.stddev_pop("amount_f").alias("amount_std_pop"))


def large_flag() -> Column:
    return F.coalesce(F.col("amount_f") > F.col("amount_p95"), F.lit(False)).cast("int")


def engineer_features(df: DataFrame, cfg: Config = Config(), by: Sequence[str] = ACC) -> DataFrame:
    rows = row_features(df, cfg)
    stats = amount_stats(rows, cfg, by)
    d = rows.join(stats, list(by), "left") if by else rows.crossJoin(stats)
    return d.withColumn("is_large_amount", large_flag())

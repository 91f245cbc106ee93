"""Registered standardization queries: driver tables are rendered
into raw export layouts by Spark and standardized back; the oracle states
the expected canonical values directly from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import standardize as ST
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlparts import with_txn
from ledgerlens.sources import statements as SS
from ledgerlens.sources.tables import txn

KEEP = ["account_id", "seq"]


@register("standardize", with_txn("""
SELECT account_id, seq, debit_credit, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       strftime(date, '%Y-%m-%d') AS date, time, mode AS transaction_type, narration AS merchant FROM txn"""))
def standardize(spark, sf_dir):
    """Raw export layout (type/mode/amount/currentBalance/ISO-offset timestamp/
    valueDate/narration) -> canonical 7 fields (wall-clock date and time)."""
    return ST.standardize(SS.render_layout_a(txn(spark, sf_dir)), keep=KEEP)


@register("std_layout_generic", with_txn("""
SELECT account_id, seq, CAST(NULL AS VARCHAR) AS debit_credit, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, strftime(date, '%Y-%m-%d') AS date, CAST(NULL AS VARCHAR) AS time,
       transaction_type, CAST(NULL AS VARCHAR) AS merchant FROM txn"""))
def std_layout_generic(spark, sf_dir):
    """Documented generic layout: unmatched headers give null fields."""
    return ST.standardize(SS.render_layout_generic(txn(spark, sf_dir)), keep=KEEP)


@register("std_layout_c", with_txn("""
SELECT account_id, seq, debit_credit, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       strftime(date, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:00') AS time, mode AS transaction_type,
       narration AS merchant FROM txn"""))
def std_layout_c(spark, sf_dir):
    """Slash dates, HH:MM times, Dr/Cr labels, $-prefixed amounts, padded text."""
    return ST.standardize(SS.render_layout_c(txn(spark, sf_dir)), keep=KEEP)


@register("type_transactions", with_txn("""
SELECT account_id, seq, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM txn"""))
def type_transactions(spark, sf_dir):
    """Standardized text fields -> typed money and timestamp."""
    t = ST.type_transactions(ST.standardize(SS.render_layout_a(txn(spark, sf_dir)), keep=KEEP))
    return t.select("account_id", "seq", "amount", "balance", "ts")


def _g1_export(spark, sf_dir):
    """The raw export with plain decimal amounts, and thousands separators on every seventh row."""
    plain = F.col("amount").cast("string")
    t = txn(spark, sf_dir)
    raw = SS.render_layout_a(t).drop("amount")
    amount = F.when(F.pmod(F.col("seq"), F.lit(7)) == 0, F.format_number(F.col("amount").cast("double"), 2)).otherwise(plain)
    return raw.join(t.select("account_id", "seq", amount.alias("amount")), ["account_id", "seq"])


@register("clean_g1", with_txn("""
SELECT account_id, seq, upper(debit_credit) AS debit_credit, mode AS transaction_type,
       CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       strftime(date, '%Y-%m-%d') AS date, narration AS merchant, strftime(date, '%Y-%m') AS month
FROM txn WHERE NOT (seq % 7 = 0 AND amount >= 1000)"""))
def clean_g1(spark, sf_dir):
    """Statement-demo cleaning: rename, coerce, fill, month, upper-case labels."""
    d = ST.clean_g1(_g1_export(spark, sf_dir))
    return d.select("account_id", "seq", "debit_credit", "transaction_type", "amount", "balance", "date",
                    "merchant", "month")


@register("clean_g1_rejects", with_txn("""
SELECT account_id, seq, 'amount is no number: ' || format('{:,.2f}', CAST(amount AS DOUBLE)) AS reject
FROM txn WHERE seq % 7 = 0 AND amount >= 1000"""))
def clean_g1_rejects(spark, sf_dir):
    """Rows whose amount is no plain number (thousands separators, as in the original), with the reason."""
    return ST.rejects_g1(_g1_export(spark, sf_dir)).select("account_id", "seq", "reject")


# messy inputs by row number: bare times, null and year-first dates, doubles of ten million and more
_MESSY = 11


@register("std_messy", with_txn("""
SELECT account_id, seq,
       CASE seq % 11 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE strftime(date, '%Y-%m-%d') END AS date,
       CASE seq % 11 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE strftime(date, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') END AS ts,
       CAST(CASE WHEN seq % 11 = 3 THEN CAST(amount AS DOUBLE) * 100000 ELSE CAST(amount AS DOUBLE) END AS DOUBLE) AS money
FROM txn"""))
def std_messy(spark, sf_dir):
    """Bare times and null dates give no date and no timestamp; money given as a
    double keeps its size when it prints with an exponent."""
    t = txn(spark, sf_dir)
    n = F.pmod(F.col("seq"), F.lit(_MESSY))
    raw = t.select("account_id", "seq",
                   F.when(n == 0, F.date_format("ts", "HH:mm")).when(n == 1, F.lit(None)).when(
                       n == 2, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "dd-MM-yyyy")).alias("Date"),
                   F.date_format("ts", "HH:mm:ss").alias("Time"),
                   F.when(n == 3, F.col("amount").cast("double") * 100000).otherwise(F.col("amount").cast("double")).alias("Amount"))
    typed = ST.type_transactions(ST.standardize(raw.select("account_id", "seq", "Date", "Time"), keep=KEEP))
    money = raw.select("account_id", "seq", C.money(F.col("Amount")).alias("money"))
    return typed.select("account_id", "seq", "date", "ts").join(money, ["account_id", "seq"])


@register("map_training_format", with_txn("""
SELECT account_id, seq, CAST(amount AS DOUBLE) AS amount, fraud AS is_fraud,
       CASE WHEN fraud = 0 THEN 0 ELSE CASE ft WHEN 'account_takeover' THEN 1 WHEN 'card_fraud' THEN 2
            WHEN 'money_laundering' THEN 3 WHEN 'none' THEN 4 END END AS fraud_type_label,
       hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
       CAST(amount AS DOUBLE) * 5 AS balance_after, mode, merchant
FROM (SELECT *, CASE WHEN amount > 20000 OR ((seq * 7919) % 1000) < 20 THEN 1 ELSE 0 END AS fraud,
             CASE WHEN NOT (amount > 20000 OR ((seq * 7919) % 1000) < 20) THEN 'none' WHEN amount > 20000 THEN 'money_laundering'
                  WHEN mode = 'ATM' THEN 'account_takeover' ELSE 'card_fraud' END AS ft FROM txn)"""))
def map_training_format(spark, sf_dir):
    """Labelled layout A -> unified training columns with class codes."""
    d = ST.map_training_format(SS.render_training_a(txn(spark, sf_dir)))
    return d.select("account_id", "seq", "amount", "is_fraud", "fraud_type_label", "hour", "day_of_week",
                    "month", "balance_after", "mode", "merchant")


@register("merchant_key", with_txn("""
SELECT account_id, seq, upper(trim(merchant)) AS merchant_key, upper(trim(mode)) AS channel,
       mode || '::' || regexp_replace(upper(narration), '[/\\s_-]?\\d{4,}$', '') AS fallback_key
FROM txn"""))
def merchant_key(spark, sf_dir):
    """Merchant key and channel extraction, plus the MODE::NARR fallback key
    when the merchant is blank."""
    t = txn(spark, sf_dir)
    fb = t.withColumn("merchant", F.lit(None).cast("string"))
    return t.select("account_id", "seq", C.merchant_key().alias("merchant_key"), C.channel().alias("channel")).join(
        fb.select("account_id", "seq", C.merchant_key().alias("fallback_key")), ["account_id", "seq"])

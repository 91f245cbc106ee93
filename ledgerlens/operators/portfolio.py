"""Statement-demo portfolio rules with a configurable threshold.

Five rules flag rows; the flag table joins reasons in rule order and caps
points at 100; the portfolio score mixes the flagged share and the mean
severity.  Each statistic is per account and computed by one grouped pass
(amount counts per (account, amount) and rows per (account, day) are the
only extra shuffles); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C

ACC = ("account_id",)


def _rupees0(c: Column) -> Column:
    return F.concat(F.lit("₹"), C.fmt0(c))


def evaluate(df: DataFrame, cfg: Config = Config(), threshold: float | None = None,
             by: Sequence[str] = ACC) -> DataFrame:
    thr = cfg.portfolio_high_value if threshold is None else threshold
    amt = F.col("amount")
    acct = df.groupBy(*by).agg(
        F.avg(amt.cast("double")).alias("p_mean"), F.stddev_samp(amt.cast("double")).alias("p_std"),
        F.coalesce(F.sum(F.when(F.upper("debit_credit") == "DEBIT", amt)), F.lit(0)).alias("p_debit"),
        F.sum(amt).alias("p_total"))
    amt_counts = df.where(amt.isNotNull()).groupBy(*by, "amount").agg(F.count(F.lit(1)).alias("p_amount_n"))
    day_counts = df.where(F.col("date").isNotNull()).groupBy(*by, "date").agg(F.count(F.lit(1)).alias("p_day_n"))
    d = (df.join(acct, list(by), "left").join(amt_counts, [*by, "amount"], "left")
         .join(day_counts, [*by, "date"], "left"))
    spike_thr = F.col("p_mean") + 2 * F.col("p_std")
    ratio = F.col("p_debit").cast("double") / F.col("p_total").cast("double")
    flags = {
        "p_high_value": F.coalesce(amt > thr, F.lit(False)),
        "p_repeated_amount": F.coalesce(F.col("p_amount_n") >= cfg.portfolio_repeat_min, F.lit(False)),
        "p_spike": F.coalesce(F.col("p_std").isNotNull() & ~F.isnan("p_std") & (F.col("p_std") > 0)
                              & (amt > spike_thr), F.lit(False)),
        "p_busy_day": F.coalesce(F.col("p_day_n") > cfg.portfolio_busy_day_min, F.lit(False)),
        "p_excess_debit": F.coalesce((F.col("p_total") > 0) & (ratio > cfg.portfolio_excess_debit_ratio)
                                     & (F.upper("debit_credit") == "DEBIT"), F.lit(False)),
    }
    reasons = {
        "p_high_value": F.concat(F.lit("High-value transaction ("), _rupees0(amt), F.lit(" > threshold ₹"),
                                 F.lit(f"{int(thr):,}" if float(thr).is_integer() else f"{thr:,}"), F.lit(")")),
        "p_repeated_amount": F.concat(F.lit("Repeated transaction amount ("), _rupees0(amt), F.lit(" appears "),
                                      F.col("p_amount_n").cast("string"), F.lit("x)")),
        "p_spike": F.concat(F.lit("Unusual spending spike ("), _rupees0(amt), F.lit(" exceeds mean+2σ = "),
                            _rupees0(spike_thr), F.lit(")")),
        "p_busy_day": F.concat(F.lit("Multiple transactions on same day ("), F.col("p_day_n").cast("string"),
                               F.lit(" txns on "), F.col("date").cast("string"), F.lit(")")),
        "p_excess_debit": F.concat(F.lit("Excessive withdrawals — debits are "),
                                   F.regexp_replace(F.format_number(ratio * 100, 1), ",", ""),
                                   F.lit("% of all transactions")),
    }
    pts = dict(cfg.portfolio_points)
    keys = ["HIGH_VALUE", "REPEATED_AMOUNT", "SPIKE", "BUSY_DAY", "EXCESS_DEBIT"]
    d = d.withColumns(flags)
    hits = [F.when(F.col(c), F.struct(reasons[c].alias("reason"), F.lit(pts[k]).alias("points")))
            for c, k in zip(flags, keys)]
    d = d.withColumn("__h", F.array_compact(F.array(*hits)))
    return d.withColumns({
        "reason": F.array_join(F.transform("__h", lambda h: h["reason"]), " | "),
        "raw_points": F.aggregate("__h", F.lit(0), lambda a, h: a + h["points"]),
    }).withColumn("risk_points", F.least(F.col("raw_points"), F.lit(100))).drop("__h")


def flag_table(df: DataFrame, cfg: Config = Config(), threshold: float | None = None,
               by: Sequence[str] = ACC) -> DataFrame:
    """One row per flagged transaction: reasons in rule order, capped points
    and the display columns (the rows already carry them: no join back)."""
    e = evaluate(df, cfg, threshold, by)
    return e.where(F.col("raw_points") > 0).select(
        *by, F.col("seq").alias("txn_index"), "reason", "risk_points", "amount", "date", "merchant",
        "transaction_type", "debit_credit", "balance")


def risk_score(df: DataFrame, cfg: Config = Config(), threshold: float | None = None,
               by: Sequence[str] = ACC) -> DataFrame:
    """flagged share x 60 + min(mean uncapped points, 100) / 100 x 40, capped at
    100 (not rounded here), and the Low / Medium / High label."""
    e = evaluate(df, cfg, threshold, by)
    g = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                           F.count(F.when(F.col("raw_points") > 0, 1)).alias("flagged"),
                           F.avg(F.when(F.col("raw_points") > 0, F.col("raw_points").cast("double"))).alias("sev"))
    score = F.when(F.col("flagged") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("flagged") / F.col("n") * 60 + F.least(F.col("sev"), F.lit(100.0)) / 100 * 40, F.lit(100.0)))
    g = g.withColumn("risk_score", score)
    label = F.when(F.col("risk_score") <= 30, "Low Risk").when(F.col("risk_score") <= 60, "Medium Risk").otherwise("High Risk")
    return g.select(*by, "n", "flagged", "risk_score", label.alias("risk_label"))

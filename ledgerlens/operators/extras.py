"""Features the reference documents but does not implement,
built as plain Spark jobs with stated, checkable formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions.quantiles import grouped_quantiles, join_groups
from ledgerlens.functions.windows import bucketed_prev, range_sums

ACC = ("account_id",)


def reconcile_balance(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """Per account: rows checked and breaks where balance != previous balance
    +/- amount (credits add, debits subtract), in (ts, seq) order."""
    d = bucketed_prev(df.select(*by, "seq", "ts", "balance"), list(by), "ts", "seq", ["balance"], prefix="prev_")
    j = df.select(*by, "seq", "amount", "debit_credit").join(d, [*by, "seq"])
    signed = F.when(C.is_credit(), F.col("amount")).otherwise(-F.col("amount"))
    exp = F.col("prev_balance") + signed
    return j.groupBy(*by).agg(F.count(F.when(F.col("prev_balance").isNotNull(), 1)).alias("checked"),
                              F.count(F.when(F.col("prev_balance").isNotNull() & (F.col("balance") != exp), 1)).alias("breaks"))


def dedupe_txn(df: DataFrame, key: str = "txn_id") -> DataFrame:
    """One row per transaction id (the earliest in statement order; among rows of one id and place
    the one with the smallest hash, once).  Rows without an id are all kept."""
    place = F.struct("seq", F.xxhash64(*df.columns).alias("hash"))
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("__first"))
    kept = (df.withColumn("__first", place).join(first, [key, "__first"], "left_semi")
            .drop("__first").dropDuplicates([key]))
    return kept.unionByName(df.where(F.col(key).isNull()))


def structuring(df: DataFrame, threshold: float = 10000.0, lower_share: float = 0.9, days: int = 6,
                min_count: int = 3, by: Sequence[str] = ACC) -> DataFrame:
    """For each near-threshold transaction (amount in [0.9 T, T)): near-threshold
    count and sum over the preceding ``days`` (inclusive window), flag when
    count >= N and sum >= T; confidence = near share of all rows in the window."""
    near = (F.col("amount") >= lower_share * threshold) & (F.col("amount") < threshold)
    w_us = days * 86400 * 1_000_000
    d = df.withColumn("__near", near)
    j = range_sums(d, list(by), "ts", "seq", w_us, 0, {
        "near_count": F.col("__near").cast("long"),
        "near_total": F.when(near, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)")),
        "window_count": F.lit(1)}, probe=near)
    return j.withColumns({
        "structuring": (F.col("near_count") >= min_count) & (F.col("near_total") >= threshold),
        "confidence": F.col("near_count") / F.col("window_count")})


def circadian(df: DataFrame, share_floor: float = 0.02, points: int = 35, by: Sequence[str] = ACC) -> DataFrame:
    """Hour-of-day histogram per account; a transaction in an hour holding
    less than ``share_floor`` of the account's rows gets ``points``."""
    d = df.withColumn("hour", F.hour("ts"))
    h = d.groupBy(*by, "hour").agg(F.count(F.lit(1)).alias("hour_count"))
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    j = d.select(*by, "seq", "hour").join(h, [*by, "hour"]).join(n, list(by))
    j = j.withColumn("hour_share", F.col("hour_count") / F.col("n"))
    return j.withColumn("circadian_points", F.when(F.col("hour_share") < share_floor, points).otherwise(0))


def spending_profile(df: DataFrame, category: str = "mode", by: Sequence[str] = ACC) -> DataFrame:
    """Per account x category: p10 / median / p90 amount, usual hour (modal,
    ties smallest), count."""
    a = F.col("amount").cast("double")
    q = grouped_quantiles(df, [*by, category], a, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    n = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"),
                                      F.mode(F.hour("ts"), True).alias("usual_hour"))        # 24 values at most
    return join_groups(n, q, [*by, category]).select(*by, category, "n", "p10", "p50", "p90", "usual_hour")


def profile_deviation(df: DataFrame, category: str = "mode", by: Sequence[str] = ACC) -> DataFrame:
    """Per transaction: amount as a multiple of its category median."""
    prof = spending_profile(df, category, by).select(*by, category, "p50")
    j = df.select(*by, "seq", category, "amount").join(prof, [*by, category])
    return j.withColumn("deviation_multiple", F.when(F.col("p50") != 0, F.col("amount").cast("double") / F.col("p50")))


def stress_index(df: DataFrame, recent_days: int = 30, by: Sequence[str] = ACC) -> DataFrame:
    """Last ``recent_days`` vs the account's earlier history: ATM count per
    30 days vs its norm, cash (ATM) amount share vs its norm; index = 50 x
    clip(atm ratio - 1, 0, 1) + 50 x clip(cash share increase, 0, 1)."""
    end = df.groupBy(*by).agg(F.max("date").alias("__end"), F.min("date").alias("__start"))
    d = df.join(end, list(by)).withColumn("__recent", F.col("date") > F.date_sub("__end", recent_days))
    atm = F.upper(F.col("mode")) == "ATM"
    amt = F.col("amount").cast("double")
    g = d.groupBy(*by).agg(
        F.count(F.when(F.col("__recent") & atm, 1)).alias("atm_recent"),
        F.count(F.when(~F.col("__recent") & atm, 1)).alias("atm_hist"),
        F.first("__end").alias("__end"), F.first("__start").alias("__start"),
        F.sum(F.when(F.col("__recent") & atm, amt)).alias("cash_recent"), F.sum(F.when(F.col("__recent"), amt)).alias("all_recent"),
        F.sum(F.when(~F.col("__recent") & atm, amt)).alias("cash_hist"), F.sum(F.when(~F.col("__recent"), amt)).alias("all_hist"))
    hist_days = F.greatest(F.datediff("__end", "__start") - recent_days + 1, F.lit(1))
    atm_norm = F.col("atm_hist") / hist_days * recent_days
    ratio = F.col("atm_recent") / F.greatest(atm_norm, F.lit(1.0))
    share_r = F.coalesce(F.col("cash_recent") / F.col("all_recent"), F.lit(0.0))
    share_h = F.coalesce(F.col("cash_hist") / F.col("all_hist"), F.lit(0.0))
    idx = 50 * C.clip(ratio - 1, 0.0, 1.0) + 50 * C.clip(share_r - share_h, 0.0, 1.0)
    return g.select(*by, "atm_recent", "atm_hist", ratio.alias("atm_ratio"), share_r.alias("cash_share_recent"),
                    share_h.alias("cash_share_hist"), idx.alias("stress_index"))


def category_drop(df: DataFrame, category: str = "merchant", recent_days: int = 30, min_norm: float = 1000.0,
                  by: Sequence[str] = ACC) -> DataFrame:
    """The category whose debits of the last ``recent_days`` fell furthest below its norm (its earlier
    debits per ``recent_days``, ``min_norm`` or more): name, recent amount, norm and drop (0-1).
    Ties: the name.  Accounts without such a category are absent."""
    ends = df.groupBy(*by).agg(F.max("date").alias("__end"), F.min("date").alias("__start"))
    d = join_groups(df.where(C.is_debit() & F.col(category).isNotNull()), ends, by)
    recent = F.col("date") > F.date_sub("__end", recent_days)
    amt = F.col("amount").cast("double")
    g = d.groupBy(*by, category, "__end", "__start").agg(
        F.coalesce(F.sum(F.when(recent, amt)), F.lit(0.0)).alias("recent_amount"),
        F.coalesce(F.sum(F.when(~recent, amt)), F.lit(0.0)).alias("__hist"))
    days = F.greatest(F.datediff("__end", "__start") - recent_days + 1, F.lit(1))
    g = g.withColumn("norm_amount", F.col("__hist") / days * recent_days).where(F.col("norm_amount") >= min_norm)
    g = g.withColumn("category_drop", C.clip(1.0 - F.col("recent_amount") / F.col("norm_amount"), 0.0, 1.0))
    worst = F.min_by(F.struct(F.col(category).alias("category"), "recent_amount", "norm_amount", "category_drop"),
                     F.struct((-F.round("category_drop", 9)).alias("d"), F.col(category).alias("c")))
    return g.groupBy(*by).agg(worst.alias("w")).select(*by, "w.*")


def stress_with_category(df: DataFrame, category: str = "merchant", recent_days: int = 30, drop_points: float = 25.0,
                         by: Sequence[str] = ACC) -> DataFrame:
    """The stress index plus up to ``drop_points`` for the deepest category drop, at most 100."""
    s = join_groups(stress_index(df, recent_days, by), category_drop(df, category, recent_days, by=by), by)
    total = F.col("stress_index") + drop_points * F.coalesce("category_drop", F.lit(0.0))
    return s.withColumn("stress_index", F.least(total, F.lit(100.0)))


def recurring_bills(df: DataFrame, key: str = "merchant", min_months: int = 3, by: Sequence[str] = ACC) -> DataFrame:
    """Debits recurring by (key, day of month) in >= ``min_months`` distinct
    months, with their mean amount."""
    d = df.where(C.is_debit() & F.col("date").isNotNull())
    return (d.groupBy(*by, F.col(key).alias("bill_key"), F.dayofmonth("date").alias("day_of_month"))
            .agg(F.count_distinct(F.date_format("date", "yyyy-MM")).alias("months"),
                 (F.sum("amount").cast("double") / F.count(F.lit(1))).alias("mean_amount"))
            .where(F.col("months") >= min_months))


def daily_forecast(df: DataFrame, days: int = 30, by: Sequence[str] = ACC) -> DataFrame:
    """30-day balance path: last balance, minus recurring bills on their day of
    month (running sum over the horizon; bills table is per account)."""
    last = df.groupBy(*by).agg(F.max_by("balance", F.struct("ts", "seq")).alias("start_balance"),
                               F.max("date").alias("end_date"))
    steps = last.select(*by, "start_balance", "end_date", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    steps = steps.withColumn("date", F.date_add("end_date", F.col("day")))
    bills = recurring_bills(df, by=by)
    due = (steps.join(bills, [*by], "inner").where(F.dayofmonth("date") == F.col("day_of_month"))
           .groupBy(*by, "day").agg(F.sum("mean_amount").alias("bills_due")))
    s = steps.join(due, [*by, "day"], "left").withColumn("bills_due", F.coalesce("bills_due", F.lit(0.0)))
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # <= 30 rows per account
    return s.select(*by, "day", "date", "bills_due",
                    (F.col("start_balance").cast("double") - F.sum("bills_due").over(w)).alias("projected_balance"))


def score_breakdown(scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per transaction: contribution list 'SIGNAL:points' (rules after the
    diminishing weights x 3, before the cap) plus the ML bonus."""
    from ledgerlens.operators.scoring import DIMINISHING, points_of
    pts = points_of(F.col("rule_flags"), cfg)
    pairs = F.arrays_zip(F.col("rule_flags").alias("f"), pts.alias("p"))
    srt = F.sort_array(F.transform(pairs, lambda x: F.struct((-x["p"]).alias("np"), x["f"].alias("f"), x["p"].alias("p"))))

    def factor(i):
        e = F.lit(DIMINISHING[-1])
        for k in range(len(DIMINISHING) - 2, -1, -1):
            e = F.when(i == k, F.lit(DIMINISHING[k])).otherwise(e)
        return e
    parts = F.transform(srt, lambda x, i: F.concat(x["f"], F.lit(":"),
                                                   F.format_number(x["p"].cast("double") * factor(i) * 3, 2)))
    ml = F.concat(F.lit("ML_BONUS:"), F.format_number(F.col("ml_score") / 100.0 * 30.0, 2))
    return scored.select("account_id", "seq", F.array_join(F.concat(parts, F.array(ml)), "|").alias("breakdown"))

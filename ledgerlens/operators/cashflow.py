"""Cash-flow runway forecast per account.

One daily-debit aggregate (account, date) feeds the spending rate, spike
days and confidence; debit rows feed the outlier percentile; credit rows the
recurring-income test.  Percentiles are grouped aggregates joined back (no
window over raw rows).  The trimmed rate is not rounded before the runway
division (the checked form; see README).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions.quantiles import grouped_quantiles, join_groups

ACC = ("account_id",)


def _pct(c: Column, q: float, cfg: Config) -> Column:
    if cfg.quantile_accuracy > 0:
        return F.percentile_approx(c, q, cfg.quantile_accuracy)
    return F.percentile(c, q)


def daily_spend(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    d = df.where(C.is_debit() & F.col("amount").isNotNull() & F.col("date").isNotNull())
    return d.groupBy(*by, "date").agg(F.sum("amount").alias("spend"))


def metrics(df: DataFrame, cfg: Config = Config(), by: Sequence[str] = ACC) -> DataFrame:
    """calendar days (+1), active debit days, totals, trimmed-mean and median
    daily spend, current balance (last non-null by statement order), start/end."""
    amt = F.col("amount")
    base = df.where(F.col("date").isNotNull()).groupBy(*by).agg(
        F.min("date").alias("statement_start"), F.max("date").alias("statement_end"))
    tot = df.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(C.is_debit(), amt)), F.lit(0)).alias("total_debits"),
        F.coalesce(F.sum(F.when(C.is_credit(), amt)), F.lit(0)).alias("total_credits"),
        F.count(F.when(C.is_debit() & amt.isNotNull(), 1)).alias("n_debits"),
        F.coalesce(F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("seq"))), F.lit(0)).alias("current_balance"))
    ds = daily_spend(df, by)
    sp = spend_stats(ds, cfg, by)
    out = base.join(tot, list(by), "left").join(sp, list(by), "left")
    return out.withColumns({
        "calendar_days": F.greatest(F.datediff("statement_end", "statement_start") + 1, F.lit(1)),
        "active_debit_days": F.coalesce("active_debit_days", F.lit(0)),
        "estimated_daily_spending": F.coalesce("estimated_daily_spending", F.lit(0.0)),
        "median_daily_spending": F.coalesce("median_daily_spending", F.lit(0.0)),
    })


def spend_stats(ds: DataFrame, cfg: Config, by: Sequence[str] = ACC) -> DataFrame:
    """Per account over its daily spends: p95 cutoff, trimmed mean (days <=
    cutoff; plain mean if none), median, spike-day count / worst day."""
    s = F.col("spend").cast("double")
    q = ds.groupBy(*by).agg(_pct(s, 1 - cfg.trim_fraction, cfg).alias("trim_cut"),
                            _pct(s, cfg.spike_percentile / 100, cfg).alias("spike_thresh"),
                            _pct(s, 0.95, cfg).alias("__p95"),
                            F.median(s).alias("median_daily_spending"),
                            F.count(F.lit(1)).alias("active_debit_days"),
                            (F.sum("spend").cast("double") / F.count(F.lit(1))).alias("plain_mean"))
    j = ds.join(q, list(by))
    spike = F.col("spend").cast("double") > F.col("spike_thresh")
    worst_key = F.struct(F.col("spend"), (-F.datediff(F.col("date"), F.lit("1970-01-01"))).alias("d"))
    g = j.groupBy(*by).agg(
        F.first("trim_cut").alias("trim_cut"), F.first("spike_thresh").alias("spike_thresh"),
        F.first("median_daily_spending").alias("median_daily_spending"),
        F.first("active_debit_days").alias("active_debit_days"), F.first("plain_mean").alias("plain_mean"),
        (F.sum(F.when(F.col("spend").cast("double") <= F.col("trim_cut"), F.col("spend"))).cast("double")
         / F.count(F.when(F.col("spend").cast("double") <= F.col("trim_cut"), 1))).alias("trimmed_mean"),
        F.count(F.when(spike, 1)).alias("spike_days"),
        F.count(F.when(s > F.col("__p95"), 1)).alias("outlier_days"),
        F.max_by(F.when(spike, F.col("date")), F.when(spike, worst_key)).alias("worst_day"),
        F.max(F.when(spike, F.col("spend"))).alias("worst_spend"))
    return g.withColumn("estimated_daily_spending", F.coalesce("trimmed_mean", "plain_mean")).drop("trimmed_mean", "plain_mean")


def forecast(m: DataFrame, cfg: Config = Config()) -> DataFrame:
    rate = F.col("estimated_daily_spending")
    bal = F.greatest(F.col("current_balance").cast("double"), F.lit(0.0))
    runway = F.when(rate > 0, F.floor(bal / rate).cast("int"))
    m = m.withColumns({"balance_pos": bal, "runway_days": runway})
    risk = (F.when(F.col("runway_days").isNull(), "UNKNOWN")
            .when((F.col("runway_days") <= 7) | (F.col("balance_pos") < cfg.low_balance_abs * 0.25), "CRITICAL")
            .when((F.col("runway_days") <= cfg.low_runway_days) | (F.col("balance_pos") < cfg.low_balance_abs), "HIGH")
            .when(F.col("runway_days") <= cfg.low_runway_days * 3, "MEDIUM").otherwise("LOW"))
    return m.withColumns({
        "depletion_date": F.when(F.col("runway_days").isNotNull(),
                                 F.date_add("statement_end", F.col("runway_days"))),
        "risk_classification": risk})


def projection(m: DataFrame, cfg: Config = Config(), by: Sequence[str] = ACC) -> DataFrame:
    """Weekly projected balances for days 0, 7, ... <= horizon, floored at 0."""
    d = m.select(*by, "statement_end", "estimated_daily_spending",
                 F.greatest(F.col("current_balance").cast("double"), F.lit(0.0)).alias("b"),
                 F.explode(F.sequence(F.lit(0), F.lit(cfg.forecast_horizon_days), F.lit(7))).alias("day"))
    return d.select(*by, "day", F.date_add("statement_end", F.col("day")).alias("date"),
                    F.greatest(F.col("b") - F.col("estimated_daily_spending") * F.col("day"), F.lit(0.0)).alias("projected_balance"))


def outliers(df: DataFrame, cfg: Config = Config(), by: Sequence[str] = ACC) -> DataFrame:
    """Accounts with >= 20 debits: amounts above their 99th percentile, count,
    largest and its label (narration -> merchant -> mode)."""
    deb = df.where(C.is_debit() & F.col("amount").isNotNull())
    a = F.col("amount").cast("double")
    many = deb.groupBy(*by).agg(F.count(F.lit(1)).alias("n_debits")).where(F.col("n_debits") >= 20)
    q = join_groups(many, grouped_quantiles(deb, by, a, {"outlier_thresh": cfg.outlier_percentile / 100},
                                            cfg.quantile_accuracy), by)
    j = deb.join(q, list(by))
    over = a > F.col("outlier_thresh")

    def ok(c):
        s = C.strip(F.col(c).cast("string"))
        return F.when(s.isNotNull() & (s != "") & ~F.lower(s).isin("nan", "none"), s)
    label = F.coalesce(ok("narration"), ok("merchant"), ok("mode"))
    key = F.struct(F.col("amount"), (-F.col("seq")).alias("s"))
    g = j.groupBy(*by).agg(F.first("outlier_thresh").alias("outlier_thresh"),
                           F.count(F.when(over, 1)).alias("outlier_count"),
                           F.max(F.when(over, F.col("amount"))).alias("largest_outlier"),
                           F.max_by(F.when(over, label), F.when(over, key)).alias("largest_label"))
    return g.where(F.col("outlier_count") > 0)


def recurring_income(df: DataFrame, cfg: Config = Config(), by: Sequence[str] = ACC) -> DataFrame:
    """Credit keys (>= min amount) seen in >= 3 distinct months.  The key
    column (narration, else merchant, else mode) is chosen per account by
    which column has any value among its qualifying credits."""
    cr = df.where(C.is_credit() & F.col("amount").isNotNull() & F.col("date").isNotNull()
                  & (F.col("amount") >= cfg.recurring_income_min_amount))
    has = cr.groupBy(*by).agg(*[(F.count(c) > 0).alias(f"h_{c}") for c in ("narration", "merchant", "mode")])
    j = cr.join(has, list(by))

    def k(c):
        return F.upper(C.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    key = (F.when(F.col("h_narration"), k("narration")).when(F.col("h_merchant"), k("merchant"))
           .when(F.col("h_mode"), k("mode")).otherwise(F.lit("UNKNOWN")))
    g = j.groupBy(*by, key.alias("income_key")).agg(
        F.count_distinct(F.date_format("date", "yyyy-MM")).alias("months"))
    return g.where(F.col("months") >= cfg.recurring_income_min_months)


def report(df: DataFrame, cfg: Config = Config(), by: Sequence[str] = ACC) -> DataFrame:
    """Metrics + forecast + warnings + confidence, one row per account."""
    m = forecast(metrics(df, cfg, by), cfg)
    o = outliers(df, cfg, by)
    r = recurring_income(df, cfg, by).groupBy(*by).agg(F.count(F.lit(1)).alias("recurring_keys"))
    j = m.join(o, list(by), "left").join(r, list(by), "left")
    rate = F.col("estimated_daily_spending")
    bal = F.col("balance_pos")
    w_low = F.when(bal < cfg.low_balance_abs, F.concat(
        F.lit("Low balance: "), C.fmt2(bal), F.lit(f" is below the {cfg.low_balance_abs:,.0f} threshold.")))
    w_run = F.when(F.col("runway_days").isNotNull() & (F.col("runway_days") < cfg.low_runway_days), F.concat(
        F.lit("Short runway: estimated "), F.col("runway_days").cast("string"),
        F.lit(" days of cash remaining at "), C.fmt2(rate), F.lit("/day spending rate.")))
    pct = int(cfg.spike_percentile)
    w_spk = F.when((F.col("active_debit_days") >= 10) & (F.col("spike_days") > 0), F.concat(
        F.col("spike_days").cast("string"), F.lit(f" high-spend day(s) detected (above {pct}th percentile: "),
        C.fmt0("spike_thresh"), F.lit("/day). Highest: "), C.fmt2("worst_spend"), F.lit(" on "),
        F.col("worst_day").cast("string"), F.lit(".")))
    opct = int(cfg.outlier_percentile)
    w_out = F.when(F.col("outlier_count") > 0, F.concat(
        F.col("outlier_count").cast("string"), F.lit(f" unusually large debit(s) detected (above {opct}th percentile: "),
        C.fmt0("outlier_thresh"), F.lit("). Largest: "), C.fmt2("largest_outlier"),
        F.coalesce(F.concat(F.lit(" ("), F.col("largest_label"), F.lit(")")), F.lit("")), F.lit(".")))
    w_inc = F.when(F.col("recurring_keys") > 0,
                   F.lit("Recurring income detected. Forecast may underestimate account longevity."))
    j = j.withColumn("warnings", F.array_compact(F.array(w_low, w_run, w_spk, w_out, w_inc)))
    enough = F.col("active_debit_days") >= 10
    share = F.col("spike_days") / F.col("active_debit_days")
    p1 = (F.col("calendar_days") >= 90).cast("int")
    p2 = F.coalesce((enough & (share <= 0.08)).cast("int"), F.lit(0))
    p3 = (F.col("n_debits") >= 100).cast("int")
    outlying = F.col("outlier_days") / F.col("active_debit_days")       # days above the 95th percentile, whatever spikes are
    p4 = F.coalesce((enough & (outlying <= 0.05)).cast("int"), F.lit(0))
    score = p1 + p2 + p3 + p4
    level = F.when(score >= 4, "High").when(score >= 2, "Medium").otherwise("Low")
    share_of = lambda c: F.concat(F.round(c * 100).cast("long").cast("string"), F.lit("%"))
    days, debits = F.col("calendar_days").cast("string"), F.coalesce("n_debits", F.lit(0)).cast("string")
    # fixed output text
    notes = F.array_compact(F.array(
        F.concat(F.when(p1 == 1, "good history (").otherwise("short history ("), days, F.lit("d)")),
        F.when(~enough, "too few active days to assess stability").when(p2 == 1, "stable daily spend").otherwise(
            F.concat(F.lit("erratic daily spend ("), share_of(share), F.lit(" spike days)"))),
        F.concat(F.when(p3 == 1, "good transaction volume (").otherwise("low transaction volume ("), debits, F.lit(")")),
        F.when(enough & (p4 == 1), "few outlier days").when(enough, F.concat(F.lit("many outlier days ("), share_of(outlying), F.lit(")")))))
    reason = F.concat(level, F.lit(" confidence ("), score.cast("string"), F.lit("/4): "), F.array_join(notes, ", "), F.lit("."))
    return j.withColumns({"confidence_score": score, "confidence_level": level, "confidence_reason": reason})

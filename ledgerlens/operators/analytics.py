"""Profiling, scalar KPIs, time-series and categorical aggregates.

Each function groups by ``by`` (default: per account).  Money is summed as
DECIMAL (order-independent) and averaged as DOUBLE sum / count.  Everything is
a hash aggregate with map-side partial aggregation; the only windows run over
already-aggregated tables (periods or merchants of one account).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions.quantiles import grouped_mode, grouped_quantiles, join_groups

ACC = ("account_id",)
EXPECTED_COLUMNS = ("date", "time", "debit_credit", "amount", "balance", "transaction_type", "merchant")


def _dsum(c: Column) -> Column:
    return F.sum(c)


def _avg(c: Column) -> Column:
    """Mean as DOUBLE(sum) / count -- bit-identical across engines."""
    return F.sum(c).cast("double") / F.count(c)


# ------------------------------------------------------------------ profiling
def profile_table(df: DataFrame) -> DataFrame:
    """rows, columns, total null cells, duplicate rows (whole table)."""
    nulls = sum((F.count(F.lit(1)) - F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0))
    stats = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("total_nulls"))
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    return stats.crossJoin(distinct).select(
        "rows", F.lit(len(df.columns)).alias("columns"), "total_nulls",
        (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def profile_columns(df: DataFrame, order: str = "seq") -> DataFrame:
    """Per column: type, non-null count, first non-null value in statement order."""
    aggs = []
    for c in df.columns:
        aggs.append(F.count(F.col(c)).alias(f"n__{c}"))
        aggs.append(F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"s__{c}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.col(f"n__{c}").alias("non_null"), F.col(f"s__{c}").alias("sample"))
            for c in df.columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validate_schema(df: DataFrame, expected: Sequence[str] = EXPECTED_COLUMNS) -> DataFrame:
    """valid, missing/extra column names (plan-time), row count, nulls per
    expected column (one aggregate pass)."""
    present = set(df.columns)
    missing = sorted(set(expected) - present)
    extra = sorted(present - set(expected))
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for c in sorted(expected):
        if c in present:
            aggs.append((F.count(F.lit(1)) - F.count(F.col(c))).alias(f"null_{c}"))
    return df.agg(*aggs).select(
        F.lit(len(missing) == 0).alias("valid"), F.lit(",".join(missing)).alias("missing_cols"),
        F.lit(",".join(extra)).alias("extra_cols"), "*")


# ------------------------------------------------------------------- KPIs
def kpis(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """total_debit, total_credit (0 when none), count, mean and exact median."""
    amt = F.col("amount")
    sums = df.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(C.is_debit(), amt)), F.lit(0)).alias("total_debit"),
        F.coalesce(F.sum(F.when(C.is_credit(), amt)), F.lit(0)).alias("total_credit"),
        F.count(F.lit(1)).alias("transaction_count"),
        _avg(amt).alias("average_transaction"))
    return join_groups(sums, grouped_quantiles(df, by, amt, {"median_transaction": 0.5}), by)


def summary_statistics(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """13 summary fields per group (closing balance = last non-null balance in
    statement order; average daily spending = debits / max(span days, 1))."""
    amt = F.col("amount")
    td = F.coalesce(F.sum(F.when(C.is_debit(), amt)), F.lit(0))
    tc = F.coalesce(F.sum(F.when(C.is_credit(), amt)), F.lit(0))
    span = F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1))
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        td.alias("total_debit"), tc.alias("total_credit"), (tc - td).alias("net_cash_flow"),
        _avg(amt).alias("average_transaction"),
        F.max(F.when(C.is_debit(), amt)).alias("largest_debit"),
        F.max(F.when(C.is_credit(), amt)).alias("largest_credit"),
        F.stddev_samp(amt.cast("double")).alias("std_dev"),
        F.min(amt).alias("min_amount"), F.max(amt).alias("max_amount"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("seq"))).alias("closing_balance"),
        F.when(F.max("date").isNotNull(), td.cast("double") / span).alias("average_daily_spending"))
    out = join_groups(stats, grouped_quantiles(df, by, amt, {"median_transaction": 0.5}), by)
    names = [c for c in out.columns if c != "median_transaction"]
    at = names.index("average_transaction") + 1
    return out.select(*names[:at], "median_transaction", *names[at:])


def summary_g1(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """Statement-demo summary: totals, mean/max/min, debit/credit totals on
    upper-case labels, modal transaction type and merchant."""
    amt = F.col("amount")
    lab = F.upper(C.strip("debit_credit"))
    sums = df.groupBy(*by).agg(
        F.sum(amt).alias("total_amount"), _avg(amt).alias("avg_amount"),
        F.max(amt).alias("max_amount"), F.min(amt).alias("min_amount"),
        F.coalesce(F.sum(F.when(lab == "DEBIT", amt)), F.lit(0)).alias("debit_total"),
        F.coalesce(F.sum(F.when(lab == "CREDIT", amt)), F.lit(0)).alias("credit_total"),
        F.count(F.lit(1)).alias("transactions"))
    sums = join_groups(sums, grouped_mode(df, by, F.col("transaction_type"), "top_type"), by)
    return join_groups(sums, grouped_mode(df, by, F.col("merchant"), "top_merchant"), by)


# ------------------------------------------------------------ time series
def daily_volume(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    return (df.where(F.col("date").isNotNull()).groupBy(*by, "date")
            .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total_amount"),
                 F.count("amount").alias("count")))


def monthly_trends(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    amt = F.col("amount")
    d = df.where(F.col("date").isNotNull()).withColumn("month", F.date_format("date", "yyyy-MM"))
    g = d.groupBy(*by, "month").agg(
        F.coalesce(F.sum(F.when(C.is_debit(), amt)), F.lit(0)).alias("total_debit"),
        F.coalesce(F.sum(F.when(C.is_credit(), amt)), F.lit(0)).alias("total_credit"),
        F.count(F.lit(1)).alias("count"))
    return g.withColumn("net", F.col("total_credit") - F.col("total_debit"))


def debit_credit_analysis(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """One row per (group, side): total, count, % by count, % by amount."""
    amt = F.col("amount")
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amt).alias("all_amt"),
        F.coalesce(F.sum(F.when(C.is_debit(), amt)), F.lit(0)).alias("d_total"),
        F.count(F.when(C.is_debit(), 1)).alias("d_count"),
        F.coalesce(F.sum(F.when(C.is_credit(), amt)), F.lit(0)).alias("c_total"),
        F.count(F.when(C.is_credit(), 1)).alias("c_count"))
    denom = F.coalesce(F.when(F.col("all_amt") != 0, F.col("all_amt")), F.lit(1)).cast("double")
    sides = F.array(
        F.struct(F.lit("debit").alias("side"), F.col("d_total").alias("total"), F.col("d_count").alias("count")),
        F.struct(F.lit("credit").alias("side"), F.col("c_total").alias("total"), F.col("c_count").alias("count")))
    out = g.select(*by, "n", denom.alias("denom"), F.explode(sides).alias("s"))
    return out.select(*by, "s.side", "s.total", "s.count",
                      (F.col("s.count") / F.col("n") * 100).alias("pct_by_count"),
                      (F.col("s.total").cast("double") / F.col("denom") * 100).alias("pct_by_amount"))


def merchant_analysis(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """Non-blank merchants: total, count (non-null amounts), mean; plus the
    number of distinct merchants of the group."""
    d = df.where(F.col("merchant").isNotNull() & (C.strip("merchant") != ""))
    g = d.groupBy(*by, "merchant").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total_amount"),
        F.count("amount").alias("count"), _avg(F.col("amount")).alias("avg_amount"))
    n = g.groupBy(*by).agg(F.count(F.lit(1)).alias("total_unique_merchants"))
    return g.join(n, list(by)) if by else g.crossJoin(n)


def top_merchants(df: DataFrame, n: int = 10, by: Sequence[str] = ACC) -> DataFrame:
    """Top-n merchants by total spend per group (ties: merchant name).  The
    window runs over the per-merchant aggregate, not raw rows."""
    m = merchant_analysis(df, by).drop("total_unique_merchants")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        F.desc("total_amount"), F.asc("merchant"))
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def txn_type_distribution(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    d = df.where(F.col("transaction_type").isNotNull() & (C.strip("transaction_type") != ""))
    g = d.groupBy(*by, "transaction_type").agg(F.count(F.lit(1)).alias("count"))
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    j = g.join(n, list(by)) if by else g.crossJoin(n)
    return j.withColumn("pct", F.col("count") / F.col("__n") * 100).drop("__n")


def _week_label(date: Column) -> Column:
    start = F.date_trunc("week", date).cast("date")
    return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def weekly_spending(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    d = df.where(F.col("date").isNotNull() & C.is_debit())
    return d.groupBy(*by, _week_label(F.col("date")).alias("week")).agg(F.sum("amount").alias("total_debit"))


def monthly_spending(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    d = df.where(F.col("date").isNotNull() & C.is_debit())
    return d.groupBy(*by, F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("amount").alias("total_debit"))


def _last_change(series: DataFrame, period: str, by: Sequence[str], out: str) -> DataFrame:
    """(last - previous) / previous * 100 over the present periods; null if
    fewer than two periods or the previous one is 0.  The window runs over
    the period aggregate (bounded by the periods of one account)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc(period))
    r = series.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 2)
    g = r.groupBy(*by).agg(F.max(F.when(F.col("__rn") == 1, F.col("total_debit"))).alias("__last"),
                           F.max(F.when(F.col("__rn") == 2, F.col("total_debit"))).alias("__prev"))
    pct = F.when(F.col("__prev").isNotNull() & (F.col("__prev") != 0),
                 (F.col("__last") - F.col("__prev")).cast("double") / F.col("__prev").cast("double") * 100)
    return g.select(*by, pct.alias(out))


def spending_trends(df: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """Week-over-week and month-over-month debit change per group."""
    wk = _last_change(weekly_spending(df, by), "week", by, "wow_change_pct")
    mo = _last_change(monthly_spending(df, by), "month", by, "mom_change_pct")
    keys = df.select(*by).distinct() if by else df.agg(F.count(F.lit(1)).alias("__rows"))
    return join_groups(join_groups(keys, wk, by), mo, by).drop("__rows")


def monthly_projection(df: DataFrame, by: Sequence[str] = ACC, opening: float | None = 50000.0,
                       months: int = 6) -> DataFrame:
    """Dashboard projection: net flow = mean monthly credit - mean monthly debit,
    compounded for ``months`` months from ``opening`` (None -> the group's
    closing balance); balance floored at 0 and rounded; band on the last raw
    balance (<10k Critical, <30k High, <60k Medium, else Low)."""
    m = monthly_trends(df, by)
    g = m.groupBy(*by).agg(
        (F.sum("total_credit").cast("double") / F.count(F.lit(1))
         - F.sum("total_debit").cast("double") / F.count(F.lit(1))).alias("net_flow"))
    if opening is None:
        close = summary_statistics(df, by).select(*by, F.col("closing_balance").cast("double").alias("opening"))
        g = g.join(close, list(by), "left")
    else:
        g = g.withColumn("opening", F.lit(float(opening)))
    g = g.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(months))))
    raw = F.col("opening") + F.col("net_flow") * F.col("k")
    last_raw = F.col("opening") + F.col("net_flow") * F.lit(months)
    band = (F.when(last_raw < 10000, "Critical").when(last_raw < 30000, "High")
            .when(last_raw < 60000, "Medium").otherwise("Low"))
    return g.select(*by, F.concat(F.lit("+"), F.col("k").cast("string"), F.lit("M")).alias("month"),
                    F.col("k").alias("step"), "net_flow",
                    F.round(F.greatest(raw, F.lit(0.0))).cast("long").alias("balance"),
                    band.alias("risk_level"))


def insights(df: DataFrame, by: Sequence[str] = ACC, top_n: int = 10) -> DataFrame:
    """Flattened insight record per group (KPIs + top merchants + WoW/MoM)."""
    s = summary_statistics(df, by).select(
        *by, "total_debit", "total_credit", "net_cash_flow", "closing_balance",
        "average_daily_spending", "largest_debit", "largest_credit",
        "average_transaction", "median_transaction")
    tm = (top_merchants(df, top_n, by).groupBy(*by)
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "merchant"))),
                                        lambda x: x["merchant"]), "|").alias("top_merchants")))
    return join_groups(join_groups(s, tm, by), spending_trends(df, by), by)


# ------------------------------------------------- distinct counts, approximate form
SKETCH_LG = 12                                       # 2^12 registers: a few KB for each group and month
SKETCH_BOUND = 3 * 1.04 / (1 << SKETCH_LG) ** 0.5    # three standard errors of an estimate, as a share (4.9 %)


def distinct_sketches(df: DataFrame, value: str, by: Sequence[str] = ("account_id",)) -> DataFrame:
    """A mergeable sketch of the distinct ``value`` per group and month: a table to store and to append to
    month by month.  Nulls are no value; rows without a date have the month null and are in no span."""
    return df.groupBy(*by, F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.hll_sketch_agg(F.col(value).cast("string"), SKETCH_LG).alias("sketch"))


def distinct_in_span(sketches: DataFrame, first: str, last: str, by: Sequence[str] = ("account_id",)) -> DataFrame:
    """Distinct values per group in the months ``first`` .. ``last`` (``yyyy-MM``, both included), merged from the
    stored sketches without the rows; a month that was stored in parts, or twice, counts once.  The estimate is within
    ``SKETCH_BOUND`` of the count in all but a few of a thousand groups, and near exact for small ones."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return (sketches.where(F.col("month").between(first, last)).groupBy(*by).agg(merged.alias("distinct_values")))

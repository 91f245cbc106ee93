"""The seven per-transaction fraud rules, their flag/reason arrays and summaries.

Scope: the reference evaluated one statement file at a time; here every
statistic is per ``account_id``.  Shuffles: (account, channel) for channel
medians, (account, date) for the shared daily aggregate (spike totals,
withdrawal counts, opening balances), (account, key, time/amount bucket) for
repeats, (account, time bucket) for the burst counts.  No per-account window
over raw rows: a hot account is spread over its time buckets.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions.dominance import CUTS, TILE_ROWS, order_key, rectangle_sums, tolerance_keys
from ledgerlens.functions.quantiles import grouped_quantiles
from ledgerlens.functions.scope import as_one_statement
from ledgerlens.functions.windows import hot_groups, range_count

ACC = "account_id"


def prepare(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds the derived keys every rule reads."""
    return df.withColumns({
        "channel": C.channel(),
        "merchant_key": C.merchant_key(),
        "is_withdrawal": C.is_withdrawal(cfg.withdrawal_keywords),
        "time_hour": C.hour_of_text("time"),
    })


# --------------------------------------------------------------------- rule 1
def channel_medians(p: DataFrame, cfg: Config = Config()) -> DataFrame:
    return (p.where(F.col("amount").isNotNull())
            .transform(grouped_quantiles, [ACC, "channel"], F.col("amount"), {"channel_median": 0.5}, cfg.quantile_accuracy))


def high_value_flag(cfg: Config) -> Column:
    m = F.col("channel_median")
    return F.coalesce(
        F.col("amount").isNotNull() & m.isNotNull() & (m != 0)
        & (F.col("amount") > F.lit(cfg.high_value_multiplier) * m)
        & (F.col("amount") > F.lit(cfg.high_value_floor)), F.lit(False))


def high_value_reason(cfg: Config) -> Column:
    return F.concat(
        F.lit("Amount "), C.fmt2("amount"), F.lit(f" exceeds {C.pyfloat(cfg.high_value_multiplier)}x "),
        F.col("channel"), F.lit(" channel median ("), C.fmt2("channel_median"),
        F.lit(f") and absolute floor ({cfg.high_value_floor:,.0f})"))


# ------------------------------------------------------- rules 2, 4, 7 (daily)
def daily_stats(p: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per (account, date): day total, withdrawal count, opening
    balance, and the account-level spike threshold (window over the small
    daily table, bounded by the number of days of one account)."""
    day = (p.where(F.col("date").isNotNull())
           .groupBy(ACC, "date")
           .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("day_total"),
                F.count(F.when(F.col("is_withdrawal"), 1)).alias("day_withdrawals"),
                F.min_by("balance", F.when(F.col("balance").isNotNull(),
                                           F.struct("ts", "seq"))).alias("day_opening")))
    w = Window.partitionBy(ACC)
    day = day.withColumns({
        "n_days": F.count(F.lit(1)).over(w),
        "median_day": F.median(F.col("day_total").cast("double")).over(w),
    })
    return day.withColumn("spike_day", spike_day(cfg))


DAILY = ("day_total", "day_withdrawals", "day_opening", "n_days", "median_day", "spike_day")


def daily_stats_in(p: DataFrame, by: Sequence[str], dated: Column, cfg: Config = Config()) -> DataFrame:
    """``p`` with the ``DAILY`` columns of ``daily_stats`` where ``dated`` holds, by windows inside the account; reads ``__us``."""
    day = Window.partitionBy(*by, "date")
    d = p.withColumns({
        "day_total": F.coalesce(F.sum("amount").over(day), F.lit(0)),
        "day_withdrawals": F.count(F.when(F.col("is_withdrawal"), 1)).over(day),
        "day_opening": F.min_by("balance", F.when(F.col("balance").isNotNull(), F.struct("ts", "seq"))).over(day),
        "__first": dated & (F.row_number().over(day.orderBy("__us")) == 1),       # one row for each day
    })
    w = Window.partitionBy(*by)
    d = d.withColumns({
        "n_days": F.count(F.when(F.col("__first"), 1)).over(w),
        "median_day": F.median(F.when(F.col("__first"), F.col("day_total").cast("double"))).over(w),
    })
    d = d.withColumn("spike_day", spike_day(cfg))
    return d.withColumns({n: F.when(dated, F.col(n)) for n in DAILY}).drop("__first")


def spike_day(cfg: Config) -> Column:
    spike = ((F.col("n_days") >= cfg.spike_min_days)
             & (F.col("day_total") > F.lit(cfg.spike_multiplier) * F.col("median_day"))
             & (F.col("day_total") > F.lit(cfg.spike_floor)))
    return F.coalesce(spike, F.lit(False))


def spike_reason(cfg: Config) -> Column:
    return F.concat(
        F.lit("Daily spend "), C.fmt2("day_total"), F.lit(" on "), F.col("date").cast("string"),
        F.lit(f" exceeded {C.pyfloat(cfg.spike_multiplier)}× median daily spend ("),
        C.fmt2("median_day"), F.lit(f") and floor ({cfg.spike_floor:,.0f})"))


def withdrawal_flag(cfg: Config) -> Column:
    return F.coalesce(F.col("is_withdrawal") & F.col("date").isNotNull()
                      & (F.col("day_withdrawals") >= cfg.withdrawal_threshold), F.lit(False))


def withdrawal_reason(cfg: Config) -> Column:
    return F.concat(F.col("day_withdrawals").cast("string"), F.lit(" withdrawals on "),
                    F.col("date").cast("string"),
                    F.lit(f" (threshold: {cfg.withdrawal_threshold})"))


def balance_drop_flag(cfg: Config) -> Column:
    o = F.col("day_opening")
    return F.coalesce(
        F.col("amount").isNotNull() & F.col("balance").isNotNull() & o.isNotNull() & (o > 0)
        & (F.col("amount").cast("double") / o.cast("double") > F.lit(cfg.balance_drop_pct)), F.lit(False))


def balance_drop_reason(cfg: Config) -> Column:
    ratio = F.col("amount").cast("double") / F.col("day_opening").cast("double")
    pct = F.regexp_replace(F.format_number(ratio * 100, 1), ",", "")
    return F.concat(
        F.lit("Transaction of "), C.fmt2("amount"), F.lit(" is "), pct,
        F.lit("% of opening balance "), C.fmt2("day_opening"), F.lit(" on "),
        F.col("date").cast("string"),
        F.lit(f" (threshold: {cfg.balance_drop_pct * 100:.0f}%)"))


# --------------------------------------------------------------------- rule 6
def late_night_flag(cfg: Config) -> Column:
    h = F.col("time_hour")
    return F.coalesce(
        F.col("amount").isNotNull() & (F.col("amount") >= cfg.late_night_min_amount)
        & ((h >= cfg.late_night_start_hour) | (h < cfg.late_night_end_hour)), F.lit(False))


def late_night_reason(cfg: Config) -> Column:
    return F.concat(
        F.lit("Transaction of "), C.fmt2("amount"), F.lit(" at "), C.safe_str("time"),
        F.lit(f" falls in late-night window ({cfg.late_night_start_hour}:00-"
              f"{cfg.late_night_end_hour}:00), min amount {cfg.late_night_min_amount:,.0f}"))


# --------------------------------------------------------------------- rule 5
def rapid_counts(p: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(account, seq, rapid_count): rows within +/- half the window (inclusive),
    itself included; only rows with a time of day."""
    half_us = _rapid_reach(cfg)
    timed = p.where(F.length(C.safe_str("time")) > 0)
    return range_count(timed, [ACC], "ts", "seq", half_us, half_us, "rapid_count",
                       bucket_seconds=cfg.time_bucket_seconds)


def _rapid_reach(cfg: Config) -> int:
    return int(cfg.rapid_window_minutes * 60 * 1_000_000 / 2)


def rapid_counts_in(account, cfg: Config = Config()) -> tuple[Column, Column]:
    """The count of ``rapid_counts`` as two growing frames over the window ``account``, and the rows that have one; reads ``__us``."""
    reach, near = _rapid_reach(cfg), account.orderBy("__us")
    has = (F.length(C.safe_str("time")) > 0) & F.col("__us").isNotNull()
    n = lambda upto: F.count(F.when(has, 1)).over(near.rangeBetween(Window.unboundedPreceding, upto))
    return n(reach) - n(-reach - 1), has


def rapid_flag(cfg: Config) -> Column:
    return F.coalesce(F.col("rapid_count") >= cfg.rapid_burst_threshold, F.lit(False))


def rapid_reason(cfg: Config) -> Column:
    return F.concat(F.col("rapid_count").cast("string"),
                    F.lit(f" transactions within {cfg.rapid_window_minutes}-minute window "
                          f"(threshold: {cfg.rapid_burst_threshold})"))


# --------------------------------------------------------------------- rule 3
DENSE_ROWS = 1024          # of a cell, beyond which its partners are counted by rectangles
CELL_WIDTHS = 4            # side of a cell, in windows of time and in tolerances of the amount


def _amount_key(tol: float):
    """Amount -> (key, lo, hi): its rank-preserving long and the limits of its partners'."""
    @F.pandas_udf("key long, lo long, hi long")
    def keys(a: pd.Series) -> pd.DataFrame:
        x = a.to_numpy(dtype="float64")
        lo, hi = tolerance_keys(x, tol)
        return pd.DataFrame({"key": order_key(x), "lo": lo, "hi": hi})
    return keys


def repeated_counts(p: DataFrame, cfg: Config = Config(), dense_rows: int = DENSE_ROWS,
                    tile_rows: int = TILE_ROWS, cuts: int = CUTS) -> DataFrame:
    """(account, seq, repeat_partners): number of OTHER rows with the same key,
    |dt| <= window and |a_i - a_j| <= tol * |a_i| (a_i = 0 -> a_j = 0).

    Exact tolerance join without all pairs of a key: rows are placed in
    (time bucket of ``CELL_WIDTHS`` windows) x (log-amount bucket) cells; a probe looks
    only at the cells that its own window and tolerance reach into, so most rows are sent
    to one cell or two.  The amount bucket is ``CELL_WIDTHS`` times as wide as the tolerance
    reaches down, -log(1 - tol); a tolerance of one or more reaches through zero:
    everything smaller, and the other sign, in buckets of log(1 + tol).
    Identical (key, ts, amount) copies are collapsed to one weighted row first.

    A cell of at most ``dense_rows`` such rows is joined to its probes, so a probe meets a bounded
    number of rows in it.  In a denser cell the partners are counted without pairs: they are the
    points of a rectangle of time and amount (``functions.dominance``), whose amount limits are the
    outermost doubles that pass the tolerance test.
    """
    key = cfg.repeated_key
    w_us = _repeat_reach(cfg)
    tol = float(cfg.repeated_tolerance)
    if tol < 0:
        raise ValueError("repeated_tolerance cannot be negative")
    base = (p.where(_can_repeat(key))
            .select(ACC, F.col(key).alias("__key"), "seq",
                    F.unix_micros("ts").alias("__t"), F.col("amount").cast("double").alias("__a")))
    cells = base.groupBy(ACC, "__key", "__t", "__a").agg(F.count(F.lit(1)).alias("__n"))
    cell_us = max(1, CELL_WIDTHS * w_us)
    time_cell = lambda t: F.floor(t / F.lit(cell_us)).cast("long")
    tb = time_cell(F.col("__t"))
    if tol == 0:                       # equal amounts only: the amount itself is the bucket
        ab, reach = F.xxhash64("__a"), F.array(F.col("__ab"))
    elif tol < 1.0:
        width = -math.log(1.0 - tol) * CELL_WIDTHS
        level = lambda a: F.floor(F.log(a) / F.lit(width)).cast("long") + F.lit(1 << 40)
        size, sign = F.abs(F.col("__a")), F.signum("__a").cast("long")
        ab = F.when(F.col("__a") == 0, F.lit(0)).otherwise(sign * level(size))
        # a little beyond the tolerance, whatever the rounding; a product that overflows or vanishes ends at the amount's limits
        slack = max(1e-15, min(1e-9, tol / 1000))
        low = F.greatest(size * F.lit((1.0 - tol) * (1 - slack)), F.lit(5e-324))
        high = F.least(size * F.lit((1.0 + tol) * (1 + slack)), F.lit(sys.float_info.max))
        reach = F.transform(F.sequence(level(low), level(high)), lambda x: sign * x)
    else:                              # reaches through zero: coarse buckets of |amount|, all that are smaller
        width = math.log(1.0 + tol)
        level = F.floor(F.log(F.greatest(F.abs(F.col("__a")), F.lit(0.01))) / F.lit(width)).cast("long")
        lowest = math.floor(math.log(0.01) / width)
        ab, reach = level, None
    cells = cells.withColumns({"__tb": tb, "__ab": ab})
    build = cells.select(ACC, "__key", "__tb", "__ab",
                         F.col("__t").alias("__tj"), F.col("__a").alias("__aj"), F.col("__n").alias("__nj"))
    times = F.sequence(time_cell(F.col("__t") - w_us), time_cell(F.col("__t") + w_us))
    if reach is None:
        # |a_j| <= (1 + tol) |a_i|: one level up and every level down to that of 0.01 and below
        to = F.sequence(F.lit(lowest).cast("long"), F.greatest(F.col("__ab") + 1, F.lit(lowest)))
    else:
        to = F.when(F.col("__a") == 0, F.array(F.col("__ab"))).otherwise(reach)
    probe = (cells.withColumn("__at", F.explode(times)).withColumn("__to", F.explode(to))
             .select(ACC, "__key", "__t", "__a", F.col("__at").alias("__tb"), F.col("__to").alias("__ab")))
    cell = [ACC, "__key", "__tb", "__ab"]
    ok = (F.abs(F.col("__t") - F.col("__tj")) <= w_us) & _alike(F.col("__a"), F.col("__aj"), tol)
    per_row = [ACC, "__key", "__t", "__a"]
    # rows bound distinct rows: where no cell has so many, the plan stays the plain join
    if base.withColumns({"__tb": tb, "__ab": ab}).groupBy(*cell).count().where(F.col("count") > dense_rows).isEmpty():
        pairs = probe.join(build, cell).where(ok)
        return _partners(base, pairs.select(*per_row, "__nj"))
    dense = (cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("__rows"))
             .where(F.col("__rows") > dense_rows).select(*cell))
    pairs = probe.join(build.join(dense, cell, "left_anti"), cell).where(ok)
    of = _amount_key(tol)
    points = (build.join(dense, cell).withColumn("__k", of("__aj"))
              .select(*cell, F.col("__tj").alias("u"), F.col("__k.key").alias("v"), F.col("__nj").alias("w")))
    asked = (probe.join(dense, cell).withColumn("__k", of("__a"))
             .select(*cell, "__t", "__a", (F.col("__t") - w_us).alias("u_lo"), (F.col("__t") + w_us).alias("u_hi"),
                     F.col("__k.lo").alias("v_lo"), F.col("__k.hi").alias("v_hi")))
    counted = rectangle_sums(points, asked, cell, ["__t", "__a"], "__nj", tile_rows, cuts)
    return _partners(base, pairs.select(*per_row, "__nj").unionByName(counted.select(*per_row, "__nj")))


def _can_repeat(key: str) -> Column:
    a = F.col("amount").cast("double")
    return (F.col("ts").isNotNull() & F.col("amount").isNotNull() & F.col(key).isNotNull() & (F.col(key) != "")
            & ~F.isnan(a) & (F.abs(a) < float("inf")))


def _alike(a: Column, other: Column, tol: float) -> Column:
    return F.when(a != 0, F.abs(a - other) / F.abs(a) <= F.lit(tol)).otherwise(other == 0)


def crowded_groups(p: DataFrame, by: Sequence[str], cfg: Config = Config()) -> DataFrame:
    """The groups in which a row of ``repeated_counts_in`` may meet more than ``DENSE_ROWS`` distinct (time, amount) of its
    key.  Time is cut as wide as a row's window is, so that a window lies in two cells at most; only keys that may have
    so many rows in all (see ``hot_groups``) are looked at closer."""
    by, key = list(by), cfg.repeated_key
    rows = p.where(_can_repeat(key)).select(*by, key, F.unix_micros("ts").alias("__us"), F.col("amount").cast("double").alias("__a"))
    rows, groups = hot_groups(rows, [*by, key], DENSE_ROWS)
    cell = F.floor(F.col("__us") / F.lit(2 * _repeat_reach(cfg) + 1)).alias("__cell")
    cells = (rows.join(groups, "__group", "left_semi").select(*by, key, "__us", "__a").distinct()
             .groupBy(*by, key, cell).agg(F.count(F.lit(1)).alias("__rows")))
    return cells.where(F.col("__rows") > DENSE_ROWS // 2).select(*by).distinct()


def _repeat_reach(cfg: Config) -> int:
    return int(cfg.repeated_window_hours * 3600 * 1_000_000)


def with_copies(d: DataFrame, by: Sequence[str], cfg: Config = Config()) -> DataFrame:
    """``d`` with ``__copies``: on one of the rows that share key, time and amount, how many they are, null on the others and on
    rows that cannot repeat.  Reads ``__us`` and ``__a``."""
    has = _can_repeat(cfg.repeated_key)
    same = Window.partitionBy(*by, cfg.repeated_key, "__us", "__a").orderBy("__us")        # all rows of it stand level
    d = d.withColumns({"__copies": F.count(F.when(has, 1)).over(same), "__nth": F.row_number().over(same)})
    return d.withColumn("__copies", F.when(has & (F.col("__nth") == 1), F.col("__copies"))).drop("__nth")


def repeated_counts_in(by: Sequence[str], cfg: Config = Config()) -> tuple[Column, Column]:
    """The count of ``repeated_counts`` from the amounts of a row's time window, each once with its copies, and the rows that
    have one; for accounts that are not among ``crowded_groups``, as each row meets all of its window.  Reads ``__us``,
    ``__a`` and ``__copies``."""
    if cfg.repeated_tolerance < 0:
        raise ValueError("repeated_tolerance cannot be negative")
    has, w_us = _can_repeat(cfg.repeated_key), _repeat_reach(cfg)
    near = Window.partitionBy(*by, cfg.repeated_key).orderBy("__us").rangeBetween(-w_us, w_us)
    amounts = F.collect_list(F.when(F.col("__copies").isNotNull(), F.struct(F.col("__a").alias("a"), F.col("__copies").alias("n")))).over(near)
    alike = F.filter(amounts, lambda x: _alike(F.col("__a"), x["a"], float(cfg.repeated_tolerance)))
    return F.aggregate(alike, F.lit(0).cast("long"), lambda n, x: n + x["n"]) - 1, has


def _partners(base: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts of all cells added up, without the row itself."""
    per_row = [ACC, "__key", "__t", "__a"]
    total = counts.groupBy(*per_row).agg((F.sum("__nj") - 1).alias("repeat_partners"))
    return base.join(total, per_row).select(ACC, "seq", "repeat_partners")


def repeated_flag(cfg: Config) -> Column:
    return F.coalesce(F.col("repeat_partners") >= cfg.repeated_min_count - 1, F.lit(False))


def repeated_reason(cfg: Config) -> Column:
    return F.concat(
        F.lit("Key '"), F.col(cfg.repeated_key if cfg.repeated_key != "merchant_key" else "merchant_key"),
        F.lit("' with amount ~"), C.fmt2("amount"), F.lit(" repeated "),
        (F.col("repeat_partners") + 1).cast("string"),
        F.lit(f"x within {cfg.repeated_window_hours}h (+/- {cfg.repeated_tolerance * 100:.0f}% tolerance)"))


# ---------------------------------------------------------------- the engine
RULE_COLUMNS = {
    "HIGH_VALUE_TRANSACTION": ("r_high_value", high_value_flag, high_value_reason),
    "SPENDING_SPIKE": ("r_spending_spike", lambda cfg: F.coalesce(F.col("spike_day"), F.lit(False)), spike_reason),
    "REPEATED_TRANSACTION": ("r_repeated", repeated_flag, repeated_reason),
    "EXCESSIVE_WITHDRAWAL": ("r_excess_withdrawal", withdrawal_flag, withdrawal_reason),
    "RAPID_TRANSACTION": ("r_rapid", rapid_flag, rapid_reason),
    "LATE_NIGHT_TRANSACTION": ("r_late_night", late_night_flag, late_night_reason),
    "BALANCE_DROP_ALERT": ("r_balance_drop", balance_drop_flag, balance_drop_reason),
}


def side_tables(p: DataFrame, cfg: Config, wanted: set[str]) -> list[tuple[DataFrame, list[str]]]:
    """Aggregates the rules need, each derived from the same prepared base
    (never from an already-joined frame, which would duplicate the plan)."""
    sides = []
    if "HIGH_VALUE_TRANSACTION" in wanted:
        sides.append((channel_medians(p, cfg), [ACC, "channel"]))
    if wanted & {"SPENDING_SPIKE", "EXCESSIVE_WITHDRAWAL", "BALANCE_DROP_ALERT"}:
        sides.append((daily_stats(p, cfg), [ACC, "date"]))
    return sides


def row_sides(p: DataFrame, cfg: Config, wanted: set[str], extra: list[DataFrame] = ()) -> list[tuple[DataFrame, list[str]]]:
    """(account, seq)-keyed side results; left joins one after the other keep the rows where the
    first has put them, so the wide transaction rows are shuffled for them only once."""
    parts = list(extra)
    if "RAPID_TRANSACTION" in wanted:
        parts.append(rapid_counts(p, cfg))
    if "REPEATED_TRANSACTION" in wanted:
        parts.append(repeated_counts(p, cfg))
    return [(x, [ACC, "seq"]) for x in parts]


def flag_columns(cfg: Config, wanted: set[str]) -> dict:
    cols = {}
    for name in cfg.rule_names:
        if name in wanted:
            c, flag, _ = RULE_COLUMNS[name]
            cols[c] = flag(cfg)
    return cols


def evaluate(df: DataFrame, cfg: Config = Config(), rules: tuple[str, ...] | None = None,
             prepared: bool = False, extra_row_sides: list[DataFrame] = ()) -> DataFrame:
    """Input rows + one boolean column per rule (``r_*``) + the statistics the
    reasons quote.  ``rules`` restricts the joins to what is needed."""
    wanted = set(rules or cfg.rule_names)
    p = df if prepared else prepare(df, cfg)
    out = p if prepared else joined_as(p, df.columns)
    # the row sides first: they add least to what later joins shuffle
    for side, keys in [*row_sides(p, cfg, wanted, list(extra_row_sides)), *side_tables(p, cfg, wanted)]:
        out = out.join(side, keys, "left")
    return (out if prepared else prepare(out, cfg)).withColumns(flag_columns(cfg, wanted))


def joined_as(prepared: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows as the joins carry them: the columns they came with and the join key ``channel``.
    What else is derived from the row alone is derived again behind the last join, so that it is
    neither shuffled nor sorted."""
    return prepared.select(*[c for c in columns if c != "channel"], "channel")


def with_rule_arrays(e: DataFrame, cfg: Config) -> DataFrame:
    pts = cfg.points
    hits = [F.when(F.col(RULE_COLUMNS[n][0]),
                   F.struct(F.lit(n).alias("flag"), RULE_COLUMNS[n][2](cfg).alias("reason"),
                            F.lit(pts[n]).alias("points")))
            for n in cfg.rule_names]
    e = e.withColumn("__hits", F.array_compact(F.array(*hits)))
    return e.withColumns({
        "rule_flags": F.transform("__hits", lambda h: h["flag"]),
        "rule_reasons": F.transform("__hits", lambda h: h["reason"]),
        "rule_score": F.aggregate("__hits", F.lit(0), lambda acc, h: acc + h["points"]),
    }).drop("__hits")


def rule_engine(df: DataFrame, cfg: Config = Config(), by=(ACC,)) -> DataFrame:
    """All rules in order: ``rule_flags`` (each once, rule order),
    ``rule_reasons`` (parallel), ``rule_score`` (sum of points).  ``by=()`` takes
    the whole table as one statement."""
    if not by:
        return as_one_statement(df, lambda d: rule_engine(d, cfg))
    return with_rule_arrays(evaluate(df, cfg), cfg)


def rule_summary(scored: DataFrame, cfg: Config = Config(), by=(ACC,)) -> DataFrame:
    """total, flagged, per-rule counts, mean flagged score, max score."""
    aggs = [F.count(F.lit(1)).alias("total_transactions"),
            F.count(F.when(F.col("rule_score") > 0, 1)).alias("flagged_transactions")]
    for n in cfg.rule_names:
        aggs.append(F.count(F.when(F.array_contains("rule_flags", n), 1)).alias(n.lower()))
    aggs += [F.avg(F.when(F.col("rule_score") > 0, F.col("rule_score").cast("double"))).alias("avg_flagged_score"),
             F.max("rule_score").alias("max_score")]
    return scored.groupBy(*by).agg(*aggs)


def rule_flagged(scored: DataFrame) -> DataFrame:
    """Flagged rows with the reference's 14 display fields, highest score first."""
    return (scored.where(F.col("rule_score") > 0)
            .select(ACC, "seq", "date", "time", "amount", "debit_credit", "merchant", "mode",
                    "transaction_type", "balance", "rule_score",
                    C.rule_level(F.col("rule_score")).alias("risk_level"),
                    F.array_join("rule_flags", "|").alias("flags"),
                    F.array_join("rule_reasons", " | ").alias("reasons"))
            .orderBy(F.desc("rule_score"), ACC, "seq"))

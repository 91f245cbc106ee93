"""ML risk score, fusion with rule evidence, categories and explanations
(SURVEY 2.9-2.10).  Flagship: :func:`score_transactions`.

Without trained models the supervised probabilities fall back to a fixed
rule mix and the isolation component is 0 (deterministic, SQL-checkable).
With a fitted :class:`ledgerlens.operators.ml.FraudModels` the probabilities
come from Spark ML pipelines scored in the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions import columns as C
from ledgerlens.functions.scope import as_one_statement
from ledgerlens.functions.windows import GROUP_ROWS, bucketed_prev, by_size, large_keys, time_bucket
from ledgerlens.operators import features as FE
from ledgerlens.operators import rules as R

ACC = ("account_id",)

# Fusion overrides: fixed values (flag set, floor), checked in this order;
# the score takes the highest floor, the label keeps the last match.
OVERRIDES = (
    (("BALANCE_DROP_ALERT", "RAPID_TRANSACTION", "LATE_NIGHT_TRANSACTION"), 75.0),
    (("EXCESSIVE_WITHDRAWAL", "RAPID_TRANSACTION"), 70.0),
    (("HIGH_VALUE_TRANSACTION", "LATE_NIGHT_TRANSACTION", "BALANCE_DROP_ALERT"), 80.0),
    (("REPEATED_TRANSACTION", "RAPID_TRANSACTION"), 65.0),
)
# Position weights of sorted rule points in the fused base score (fixed values).
DIMINISHING = (1.0, 0.50, 0.25, 0.10)
G3_BOOST_FACTORS = (1.0, 0.6, 0.3, 0.1)


def fallback_prob() -> Column:
    s = (F.col("is_large_amount") * 0.25 + F.col("is_night") * 0.20 + F.col("balance_zeroed_out") * 0.25
         + F.col("is_near_threshold") * 0.20 + F.col("is_round_amount") * 0.10)
    return C.clip(s.cast("double"), 0.0, 1.0)


def velocity_from_gap(gap_s: Column) -> Column:
    g = F.coalesce(gap_s, F.lit(3600.0))
    return (F.when(g < 60, 1.0).when(g < 300, 0.7).when(g < 900, 0.4).when(g < 3600, 0.2).otherwise(0.0))


def velocity_table(df: DataFrame, cfg: Config, by: Sequence[str] = ACC) -> DataFrame:
    """(keys, seq, score_velocity) from the gap (s) to the previous transaction
    of the group by (ts, seq); narrow, joined to the wide rows once."""
    narrow = df.select(*by, "seq", "ts")
    d = bucketed_prev(narrow, list(by), "ts", "seq", ["ts"], prefix="__prev_",
                      bucket_seconds=cfg.time_bucket_seconds)
    gap = (F.unix_micros("ts") - F.unix_micros("__prev_ts")) / 1e6
    return d.select(*by, "seq", velocity_from_gap(gap).alias("score_velocity"))


def given_velocity(d: DataFrame, by: Sequence[str] = ACC) -> DataFrame:
    """A provided ``velocity_score`` column, scaled by its group maximum."""
    mx = d.groupBy(*by).agg(F.max(F.coalesce(F.col("velocity_score").cast("double"), F.lit(0.0))).alias("__vmax"))
    d = d.join(mx, list(by), "left")
    return d.withColumn("score_velocity", C.clip(F.coalesce(F.col("velocity_score").cast("double"), F.lit(0.0))
                                                 / (F.col("__vmax") + 1e-9), 0.0, 1.0)).drop("__vmax")


def given_signals(d: DataFrame, by: Sequence[str]) -> DataFrame:
    """Provided ``spending_deviation_score`` and ``geo_anomaly_score`` columns scaled by their
    group maximum and cut to 0..1, as ``__sds`` and ``__geo`` (absent columns add nothing)."""
    found = [(c, out) for c, out in (("spending_deviation_score", "__sds"), ("geo_anomaly_score", "__geo")) if c in d.columns]
    if not found:
        return d
    most = [F.max(FE.provided(d, c)).alias(f"{out}_max") for c, out in found]
    top = d.groupBy(*by).agg(*most)
    d = d.join(top, list(by), "left") if by else d.crossJoin(top)          # one row without groups
    for c, out in found:
        d = d.withColumn(out, C.clip(FE.provided(d, c) / (F.col(f"{out}_max") + 1e-9), 0.0, 1.0)).drop(f"{out}_max")
    return d


def spending_dev(d: DataFrame) -> Column:
    """A provided score as it is, else the mean of the amount's deviation and a provided geo score."""
    if "__sds" in d.columns:
        return F.col("__sds")
    z = F.abs((F.col("amount_f") - F.col("amount_mean")) / (F.coalesce(F.col("amount_std_pop"), F.lit(0.0)) + 1e-9))
    zn = C.clip(z / 5.0, 0.0, 1.0)
    geo = F.col("__geo") if "__geo" in d.columns else F.lit(0.0)
    return C.clip((zn + geo) / 2.0, 0.0, 1.0)


def ml_components(d: DataFrame, cfg: Config = Config(), models=None) -> DataFrame:
    """G4 ML score on rows that already carry features, ``score_velocity``
    and the amount statistics: .60 iso + 15 xgb + 5 rf + 10 velocity +
    10 spending deviation, clipped to 0-100."""
    d = d.withColumn("score_spending_dev", spending_dev(d)).drop("__sds", "__geo")
    if models is not None:
        d = models.transform(d)          # adds xgb_prob, rf_prob, iso_score, confidence_score
    else:
        d = d.withColumns({"xgb_prob": fallback_prob(), "iso_score": F.lit(0.0),
                           "confidence_score": F.lit(1.0)})
        d = d.withColumn("rf_prob", F.col("xgb_prob"))
    d = d.withColumns({
        "score_iso_component": F.col("iso_score") * 0.60,
        "score_xgb_component": F.col("xgb_prob") * 15.0,
        "score_rf_component": F.col("rf_prob") * 5.0,
        "velocity_component": F.col("score_velocity") * 10.0,
        "spending_dev_component": F.col("score_spending_dev") * 10.0,
    })
    raw = (F.col("score_iso_component") + F.col("score_xgb_component") + F.col("score_rf_component")
           + F.col("velocity_component") + F.col("spending_dev_component"))
    d = d.withColumn("ml_score", C.clip(raw, 0.0, 100.0))
    learned = models.predicted_type(F.col("ml_score"), cfg.fraud_type_threshold) if models is not None else None
    kind = learned if learned is not None else fraud_type_heuristic(F.col("ml_score"), cfg)
    return d.withColumns({"fraud_probability": F.col("ml_score") / 100.0, "fraud_type_predicted": kind})


def fraud_type_heuristic(score: Column, cfg: Config = Config()) -> Column:
    return (F.when(score < cfg.fraud_type_threshold, "Normal")
            .when(F.col("is_near_threshold") == 1, "Smurfing / Structuring")
            .when((F.col("is_early_morning") == 1) & (F.col("is_large_amount") == 1), "Account Takeover")
            .when(F.col("balance_zeroed_out") == 1, "Account Draining")
            .when(F.col("amount_to_balance_ratio") > 2, "Overdraft Fraud")
            .when((F.col("is_large_amount") == 1) & (F.col("is_round_amount") == 1), "Money Laundering")
            .when(F.col("is_night") == 1, "Unauthorized Access")
            .otherwise("General Fraud"))


def _diminishing(points: Column, factors: Sequence[float]) -> Column:
    srt = F.sort_array(points, asc=False)
    tail = factors[-1]

    def factor(i):
        e = F.lit(tail)
        for k in range(len(factors) - 2, -1, -1):
            e = F.when(i == k, F.lit(factors[k])).otherwise(e)
        return e
    weighted = F.transform(srt, lambda p, i: p.cast("double") * factor(i))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def points_of(flags: Column, cfg: Config) -> Column:
    m = F.create_map(*[x for n, p in cfg.rule_points for x in (F.lit(n), F.lit(p))])
    return F.transform(flags, lambda f: m[f])


def fuse(d: DataFrame, cfg: Config = Config(), rules_only: bool = True) -> DataFrame:
    """'Rules base + ML bonus': base = min(3 * diminishing sum of sorted
    points, 70); bonus = 0.30 * ml; floors from rule combinations."""
    flags = F.col("rule_flags")
    base = F.least(_diminishing(points_of(flags, cfg), DIMINISHING) * 3, F.lit(70.0))
    d = d.withColumns({"rule_boost_applied": base, "ml_bonus": F.col("ml_score") / 100.0 * 30.0})
    floor = F.lit(0.0)
    label = F.lit(None).cast("string")
    hit_any = F.lit(False)
    for names, fl in OVERRIDES:
        cond = F.lit(True)
        for n in names:
            cond = cond & F.array_contains(flags, n)
        floor = F.when(cond, F.greatest(floor, F.lit(fl))).otherwise(floor)
        label = F.when(cond, F.lit(" + ".join(names))).otherwise(label)
        hit_any = hit_any | cond
    raw = F.col("rule_boost_applied") + F.col("ml_bonus")
    raw = F.when(hit_any, F.greatest(raw, floor)).otherwise(raw)
    dominant = (F.lit("RULES") if rules_only else
                F.when(F.col("rule_boost_applied") > F.col("ml_bonus"), "RULES").otherwise("ML"))
    return d.withColumns({
        "hard_override_applied": hit_any, "override_rule": label,
        "suppression_applied": F.lit(False), "dominant_signal": dominant,
        "final_risk_score": C.clip(raw, 0.0, 100.0),
    })


def combined_reason() -> Column:
    reasons = F.col("rule_reasons")
    ml0 = F.format_number(F.col("ml_score"), 0)
    rules_txt = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("no rule flags")
    top2 = F.when(F.size(reasons) > 0, F.array_join(F.slice(reasons, 1, 2), "; ")).otherwise("no rule flags")
    comps = F.array(
        F.struct(F.col("score_iso_component").alias("v"), F.lit(-0).alias("i"), F.lit("Isolation Forest").alias("n"), F.lit("60.0").alias("cap")),
        F.struct(F.col("score_xgb_component").alias("v"), F.lit(-1).alias("i"), F.lit("XGBoost").alias("n"), F.lit("15.0").alias("cap")),
        F.struct(F.col("score_rf_component").alias("v"), F.lit(-2).alias("i"), F.lit("Random Forest").alias("n"), F.lit("5.0").alias("cap")),
        F.struct(F.col("velocity_component").alias("v"), F.lit(-3).alias("i"), F.lit("Velocity").alias("n"), F.lit("10.0").alias("cap")),
        F.struct(F.col("spending_dev_component").alias("v"), F.lit(-4).alias("i"), F.lit("Spending Deviation").alias("n"), F.lit("10.0").alias("cap")))
    top = F.array_max(comps)   # ties keep the first (larger i = -index)
    flags_txt = F.when(F.size("rule_flags") > 0, F.array_join("rule_flags", ", ")).otherwise("no rule flags")
    ml_txt = F.concat(F.lit("ML model: "), F.col("fraud_type_predicted"), F.lit(" — dominant component: "),
                      top["n"], F.lit(" ("), F.regexp_replace(F.format_number(top["v"], 1), ",", ""),
                      F.lit("/"), top["cap"], F.lit(" pts). Rules: "), flags_txt)
    both_txt = F.concat(F.lit("ML model flagged as "), F.col("fraud_type_predicted"), F.lit(" ("), ml0,
                        F.lit("/100) + Rules confirmed: "), top2)
    rules_only_txt = F.concat(F.lit("Rule-based flags: "), rules_txt, F.lit(". ML score below threshold ("),
                              ml0, F.lit("/100)"))
    return (F.when(F.col("dominant_signal") == "BOTH", both_txt)
            .when(F.col("dominant_signal") == "ML", ml_txt).otherwise(rules_only_txt))


def joined_statistics(df: DataFrame, cfg: Config, by: Sequence[str], velocity: bool) -> DataFrame:
    """``df`` with the statistics that rules and scores read, each from an aggregate joined back, so that a
    large account is spread over its time buckets, channels and days.

    Amount stats and channel medians are one table on (account, channel) (small, broadcast by AQE when its
    measured size allows), daily stats one on (account, date).  Bursts, repeats and velocity are joined on
    (account, seq) one after the other, which shuffles the rows once, and first, while they are narrow."""
    base = R.prepare(FE.row_features(df, cfg), cfg)
    wanted = set(cfg.rule_names)
    out = R.joined_as(base, df.columns)
    sides = R.side_tables(base, cfg, wanted)
    stats = base.select(*by, "channel").distinct().join(FE.amount_stats(base, cfg, by), list(by), "left")
    for side, keys in [s for s in sides if "channel" in s[1]]:
        stats = stats.join(side, keys, "left")
    rows = R.row_sides(base, cfg, wanted, [velocity_table(base, cfg, by)] if velocity else [])
    for side, keys in [*rows, (stats, [*by, "channel"]), *[s for s in sides if "channel" not in s[1]]]:
        out = out.join(side, keys, "left")
    return out


def statistics_in_place(df: DataFrame, cfg: Config, by: Sequence[str], velocity: bool) -> DataFrame:
    """What ``joined_statistics`` returns, for accounts that one task holds: all rows are shuffled once, by
    account, and every statistic is a window over them there (but for the moments of the amount, one row per
    account, which are joined where the rows are).

    As in a join, a row without account, seq or date has no statistics by it, and rows that share
    (account, seq) meet each other's bursts, repeats and velocities."""
    by, wanted = list(by), set(cfg.rule_names)
    # what a row derives from itself is derived behind the shuffle
    d = df.repartition(*by).join(FE.amount_moments(FE.row_features(df, cfg), by), by, "left")
    d = R.prepare(FE.row_features(d, cfg), cfg)
    own = [c for c in df.columns if c not in (*by, "seq", "channel", "date")]
    us, a = F.unix_micros("ts"), F.col("amount").cast("double")
    d = d.select("*", time_bucket("ts", cfg.time_bucket_seconds).alias("__day"), us.alias("__us"), a.alias("__a"))
    has_account = F.lit(True)
    for c in by:
        has_account = has_account & F.col(c).isNotNull()
    account = Window.partitionBy(*by)
    row = {}                # statistics of a row, and the rows that have them
    if velocity:
        gap = (F.col("__us") - F.lag("__us").over(account.orderBy("__day", "ts", "seq"))) / 1e6
        row["score_velocity"] = (velocity_from_gap(gap), F.lit(True))
    if "RAPID_TRANSACTION" in wanted:
        row["rapid_count"] = R.rapid_counts_in(account, cfg)
    if "REPEATED_TRANSACTION" in wanted:
        partners, has = R.repeated_counts_in(by, cfg)       # at once, behind the window that has sorted the rows for it
        d = R.with_copies(d, by, cfg).withColumn("__partners", partners)
        row["repeat_partners"] = (F.col("__partners"), has)
    group = {"amount_mean": F.col("amount_mean"), "amount_std_pop": F.col("amount_std_pop"),
             "amount_p95": quantile_over("amount_f", 0.95, account, cfg.quantile_accuracy)}
    if "HIGH_VALUE_TRANSACTION" in wanted:
        group["channel_median"] = quantile_over("__a", 0.5, Window.partitionBy(*by, "channel"), cfg.quantile_accuracy)
    d = d.select(*by, "seq", "channel", "date", *own, *[stat.alias(n) for n, (stat, _) in row.items()],
                 *[has.alias(f"__has_{n}") for n, (_, has) in row.items()],
                 *[F.when(has_account, e).alias(n) for n, e in group.items()], "__us", "is_withdrawal")
    daily = []
    if wanted & {"SPENDING_SPIKE", "EXCESSIVE_WITHDRAWAL", "BALANCE_DROP_ALERT"}:
        daily = list(R.DAILY)
        d = R.daily_stats_in(d, by, has_account & F.col("date").isNotNull(), cfg)
    # all statistics are there, so rows may come to be more
    same = Window.partitionBy(*by, "seq")
    known = has_account & F.col("seq").isNotNull()
    d = d.withColumns({f"__all_{n}": F.when(known, F.collect_list(F.when(F.col(f"__has_{n}"), F.struct(n))).over(same)) for n in row})
    for n in row:
        d = d.select("*", F.explode_outer(f"__all_{n}").alias(f"__one_{n}"))
    return d.select(*by, "date", "channel", "seq", *own, *[F.col(f"__one_{n}")[n].alias(n) for n in row], *group, *daily)


def quantile_over(value: str, share: float, window, accuracy: int) -> Column:
    """The quantile of ``grouped_quantiles`` over a window's rows."""
    if accuracy > 0:
        return F.percentile_approx(value, share, accuracy).over(window)
    return F.percentile(value, F.lit(share)).over(window)


def score_transactions(df: DataFrame, cfg: Config = Config(), models=None,
                       by: Sequence[str] = ACC) -> DataFrame:
    """Features -> seven rules -> ML score -> fusion -> category/explanations.

    One base frame (row-local features + rule keys).  Accounts that one task holds (at most ``GROUP_ROWS`` rows,
    and none of ``R.crowded_groups``) get their statistics where one shuffle by account has put
    their rows, larger ones from aggregates joined back.  Either carries the columns that the rows came with; the
    row-local features are derived behind.  ``by=()`` takes the whole table as one statement."""
    if not by:
        return as_one_statement(df, lambda d: score_transactions(d, cfg, models))
    df = FE.resolve_columns(df)
    by, wanted, given = list(by), set(cfg.rule_names), "velocity_score" in df.columns
    large = large_keys(df, by, GROUP_ROWS)
    if "REPEATED_TRANSACTION" in wanted:
        keyed = R.prepare(FE.row_features(df, cfg), cfg)
        large = large.unionByName(R.crowded_groups(keyed, by, cfg)).distinct()
    out = by_size(df, by, large, lambda d: statistics_in_place(d, cfg, by, not given),
                  lambda d: joined_statistics(d, cfg, by, not given))
    out = R.prepare(FE.row_features(out, cfg), cfg).withColumn("is_large_amount", FE.large_flag())
    if given:
        out = given_velocity(out, by)
    out = R.with_rule_arrays(out.withColumns(R.flag_columns(cfg, wanted)), cfg)
    scored = ml_components(given_signals(out, by), cfg, models)
    fused = fuse(scored, cfg, rules_only=models is None)
    return fused.withColumns({
        "risk_category": C.risk_category(F.col("final_risk_score"), cfg.compat),
        "combined_reason": combined_reason(),
        "is_fraud_predicted": (F.col("final_risk_score") >= cfg.flag_threshold).cast("int"),
    })

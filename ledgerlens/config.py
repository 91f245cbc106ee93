"""Thresholds and weights.

The numbers below are fixed values: they must equal the behaviour being
reproduced, so they are stated here once, plainly, and every operator reads
them from a ``Config`` instance (they become literals in the Spark plan).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    # --- fixed values: transaction rules -----------------------------------
    high_value_multiplier: float = 5.0
    high_value_floor: float = 5000.0
    spike_min_days: int = 7
    spike_multiplier: float = 4.0
    spike_floor: float = 10000.0
    repeated_min_count: int = 3
    repeated_window_hours: int = 24
    repeated_tolerance: float = 0.02
    repeated_key: str = "merchant_key"          # or "mode" for the fixture
    withdrawal_threshold: int = 4
    withdrawal_keywords: tuple[str, ...] = (
        "atm", "cash", "withdrawal", "cash wdl", "cashout", "cdm",
        "pos cash", "wdrawal", "wdrl",
    )
    rapid_window_minutes: int = 10              # the rule looks +/- half of it
    rapid_burst_threshold: int = 5
    late_night_start_hour: int = 23
    late_night_end_hour: int = 5
    late_night_min_amount: float = 2000.0
    balance_drop_pct: float = 0.40
    rule_points: tuple[tuple[str, int], ...] = (
        ("HIGH_VALUE_TRANSACTION", 15),
        ("SPENDING_SPIKE", 10),
        ("REPEATED_TRANSACTION", 10),
        ("EXCESSIVE_WITHDRAWAL", 15),
        ("RAPID_TRANSACTION", 10),
        ("LATE_NIGHT_TRANSACTION", 10),
        ("BALANCE_DROP_ALERT", 15),
    )

    # --- fixed values: portfolio rules (statement demo) --------------------
    portfolio_high_value: float = 50000.0
    portfolio_points: tuple[tuple[str, int], ...] = (
        ("HIGH_VALUE", 30), ("REPEATED_AMOUNT", 20), ("SPIKE", 25),
        ("BUSY_DAY", 15), ("EXCESS_DEBIT", 10),
    )
    portfolio_repeat_min: int = 3
    portfolio_busy_day_min: int = 5               # strictly more than this
    portfolio_excess_debit_ratio: float = 0.8

    # --- fixed values: ML score, calibration, fusion -----------------------
    calibration_k: float = 0.12
    calibration_stretch_weight: float = 0.70
    calibration_raw_weight: float = 0.30
    ml_weights_g3: tuple[float, float, float, float, float] = (0.55, 0.15, 0.15, 0.10, 0.05)
    fusion_boost_weight: float = 0.15
    flag_threshold: float = 61.0
    fraud_type_threshold: float = 41.0
    episode_gap_hours: float = 24.0

    # --- fixed values: cash flow -------------------------------------------
    low_runway_days: int = 30
    low_balance_abs: float = 5000.0
    recurring_income_min_months: int = 3
    recurring_income_min_amount: float = 1000.0
    forecast_horizon_days: int = 90
    outlier_percentile: float = 99.0
    spike_percentile: float = 95.0
    trim_fraction: float = 0.05

    # --- fixed values: context-line statement text ---------------------------
    context_amount_pattern: str = r"(?<!\d)(\d{1,3}(?:,\d{2,3})+\.\d{2})(?!\d)"   # amounts carry a comma group
    context_balance_from: float = 500_000.0       # amounts from here on are balances
    context_narration_words: int = 8              # of the short narration; the full one is a column beside it

    # --- compatibility switches (see README "quirks") ----------------------
    compat: bool = False              # reproduce band gaps / sign-erasing cleaning
    quantile_accuracy: int = 0        # 0 = exact percentile; >0 = percentile_approx

    # --- physical knobs ----------------------------------------------------
    time_bucket_seconds: int = 86400  # sub-partition of long per-account scans

    @property
    def points(self) -> dict[str, int]:
        return dict(self.rule_points)

    @property
    def rule_names(self) -> list[str]:
        return [name for name, _ in self.rule_points]

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)

    @staticmethod
    def fixture() -> "Config":
        """Parameters under which r_rapid / r_repeated / withdrawals hit on the
        driver's `events`-derived fixture (defaults give zero hits there)."""
        return Config(
            rapid_window_minutes=10, rapid_burst_threshold=2,
            repeated_key="mode", repeated_tolerance=0.25, repeated_window_hours=24,
            withdrawal_threshold=3,
        )


DEFAULT = Config()

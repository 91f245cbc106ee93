"""Reusable column expressions (all built-in functions; no Python UDFs)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WS = " \t\n\r\x0b\x0c"


def strip(c: Column | str) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (trim of a character set,
    no regex per row)."""
    return F.btrim(col(c), F.lit(_WS))


def blank_to_null(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s == "", F.lit(None)).otherwise(s)


def safe_str(c: Column | str) -> Column:
    """null -> '' ; otherwise stripped text."""
    return F.coalesce(strip(col(c).cast("string")), F.lit(""))


def title_label(c: Column | str) -> Column:
    """``str.strip().str.title()`` for one-word labels (Debit / Credit)."""
    return F.initcap(F.lower(strip(c)))


def is_debit(c: Column | str = "debit_credit") -> Column:
    return F.coalesce(title_label(c) == "Debit", F.lit(False))


def is_credit(c: Column | str = "debit_credit") -> Column:
    return F.coalesce(title_label(c) == "Credit", F.lit(False))


# Trailing reference ids stripped from narrations before keying (fixed pattern).
TRAILING_ID = r"[/\s_-]?\d{4,}$"


def merchant_key(merchant: str = "merchant", mode: str = "mode", narration: str = "narration") -> Column:
    """merchant (upper) if non-blank; else MODE::NARR / MODE / NARR; else null."""
    m = safe_str(merchant)
    mo = F.upper(safe_str(mode))
    nar = strip(F.regexp_replace(F.upper(safe_str(narration)), TRAILING_ID, ""))
    return (F.when(m != "", F.upper(m))
            .when((mo != "") & (nar != ""), F.concat(mo, F.lit("::"), nar))
            .when(mo != "", mo)
            .when(nar != "", nar))


def channel(mode: str = "mode", narration: str = "narration") -> Column:
    """mode (upper) unless blank/OTHERS; else first token of narration split on
    '/' or whitespace; else UNKNOWN."""
    mo = F.upper(safe_str(mode))
    nar = F.upper(safe_str(narration))
    tok = F.split(nar, r"[/\s]").getItem(0)
    return (F.when((mo != "") & (mo != "OTHERS"), mo)
            .when((nar != "") & (tok != ""), tok)
            .otherwise(F.lit("UNKNOWN")))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    pattern = "|".join(re.escape(w) for w in words)
    return F.coalesce(c.rlike(pattern), F.lit(False))


def is_withdrawal(keywords: Iterable[str], ttype: str = "transaction_type",
                  narration: str = "narration") -> Column:
    combined = F.concat(F.lower(safe_str(ttype)), F.lit(" "), F.lower(safe_str(narration)))
    return contains_any(combined, keywords)


def hour_of_text(time: str = "time") -> Column:
    """int(time.split(':')[0]); null when unparseable."""
    part = strip(F.split(safe_str(time), ":").getItem(0))
    return F.when(part.rlike(r"^[+-]?\d{1,9}$"), part.cast("int"))


def fmt2(c: Column | str) -> Column:
    """Python ``f'{x:,.2f}'``."""
    return F.format_number(col(c).cast("double"), 2)


def fmt0(c: Column | str) -> Column:
    """Python ``f'{x:,.0f}'``."""
    return F.format_number(col(c).cast("double"), 0)


def pyfloat(x: float | int) -> str:
    """How Python prints the configured constant inside an f-string."""
    return str(x)


def calibrate(raw: Column, k: float = 0.12, stretch: float = 0.70, raww: float = 0.30) -> Column:
    stretched = F.lit(100.0) / (F.lit(1.0) + F.exp(F.lit(-k) * (raw - F.lit(50.0))))
    return clip(F.lit(stretch) * stretched + F.lit(raww) * raw, 0.0, 100.0)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


# Risk bands: fixed values (lo, hi, label) of the 0-100 final score.
RISK_BANDS = ((0, 20, "Very Low"), (21, 40, "Low"), (41, 60, "Medium"),
              (61, 80, "High"), (81, 95, "Very High"), (96, 100, "Critical"))


def risk_category(score: Column, compat: bool = False) -> Column:
    """Contiguous bands by default (20.5 -> Low); ``compat`` keeps the
    original inclusive integer bands where fractional gaps fall to Critical."""
    if compat:
        e = None
        for lo, hi, label in RISK_BANDS:
            cond = (score >= lo) & (score <= hi)
            e = F.when(cond, label) if e is None else e.when(cond, label)
        return e.otherwise("Critical")
    e = None
    for lo, hi, label in RISK_BANDS:
        cond = score <= hi
        e = F.when(cond, label) if e is None else e.when(cond, label)
    return e.otherwise("Critical")


def rule_level(score: Column) -> Column:
    return (F.when(score >= 60, "CRITICAL").when(score >= 40, "HIGH")
            .when(score >= 20, "MODERATE").otherwise("LOW"))


def money(c: Column, compat: bool = False) -> Column:
    """Money text or number -> double (null or nothing numeric -> 0).  A plain number, with or
    without an exponent (as doubles of ten million and more print), is taken as it is; from other
    text all but digits, '.' and '-' is stripped.  ``compat`` erases minus signs."""
    s = c.cast("string")
    plain = F.when(s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), s.try_cast("double"))
    if compat:
        plain = F.abs(plain)
    stripped = F.regexp_replace(s, r"[^\d.]" if compat else r"[^\d.\-]", "").try_cast("double")
    return F.coalesce(plain, stripped, F.lit(0.0))

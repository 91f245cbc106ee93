"""One whole table as a single statement, for operators that work per account."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "account_id"


def as_one_statement(df: DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a per-account operator as if all rows were of one account; the rows' own
    ``account_id`` comes back if the operator keeps rows.  The helpers behind the operators split
    an account's rows by time and value, so one account with all rows is dealt out like many."""
    own = "__own_account"
    d = df.withColumn(own, F.col(KEY)) if KEY in df.columns else df
    out = op(d.withColumn(KEY, F.lit(0).cast("long")))
    if own in out.columns:
        return out.withColumn(KEY, F.col(own)).drop(own)
    return out.drop(KEY)

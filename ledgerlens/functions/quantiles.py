"""Exact grouped quantiles and modes that stay balanced when one group is huge.

``percentile`` and ``mode`` keep a map of every distinct value of a group in one
reducer.  Here values are counted per (group, value) with partial aggregation, the
counts are ranked inside (group, value range), and the ranges of a group are added up
through one row each, so a group holding a third of all rows is spread over its ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges per doubling of the absolute value.
PER_DOUBLING = 16


def value_range(v: Column) -> Column:
    """A number that never falls as ``v`` rises: ranges of one part in sixteen of a doubling."""
    step = F.floor(F.log2(F.abs(v)) * PER_DOUBLING).cast("int") + F.lit(1 << 16)     # doubles reach down to 2^-1074
    return F.when(v == 0, 0).when(v > 0, step).otherwise(-step)


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: Column, wanted: Mapping[str, float],
                      accuracy: int = 0) -> DataFrame:
    """``by`` + one double column per entry of ``wanted`` (name -> share): quantiles interpolated
    between the two nearest ranks, null for groups without a value.  ``accuracy`` above 0 takes
    mergeable sketches of that accuracy instead."""
    by = list(by)
    v = value.cast("double")
    if accuracy > 0:
        return df.groupBy(*by).agg(*[F.percentile_approx(v, q, accuracy).alias(n) for n, q in wanted.items()])
    counts = (df.select(*by, v.alias("__v")).groupBy(*by, "__v").agg(F.count("__v").alias("__c"))
              .withColumn("__r", F.when(F.col("__v").isNotNull(), value_range(F.col("__v")))))
    ranges = counts.groupBy(*by, "__r").agg(F.sum("__c").alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))           # one row per range
    upto = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.sum("__n").over(group) - 1
    ranges = ranges.withColumns({"__before": F.sum("__n").over(upto) - F.col("__n"), "__last": last})
    # ranges that hold one of the ranks; a group without values keeps its null range
    ranks = {n: F.col("__last") * F.lit(float(q)) for n, q in wanted.items()}
    holds = F.lit(False)
    for p in ranks.values():
        for rank in (F.floor(p), F.ceil(p)):
            holds = holds | ((rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__n")))
    ranges = ranges.where(holds | (F.col("__last") < 0)).select(
        *[F.col(c).alias(f"__k_{c}") for c in by], F.col("__r").alias("__rr"), "__before", "__last")
    same = F.col("__r").eqNullSafe(F.col("__rr"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = counts.join(ranges, same)
    w = Window.partitionBy(*by, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__hi", F.col("__before") + F.sum("__c").over(w))
    lo = F.col("__hi") - F.col("__c")
    at = lambda rank: F.max(F.when((rank >= lo) & (rank < F.col("__hi")), F.col("__v")))
    picked = inside.groupBy(*by).agg(
        F.max("__last").alias("__last"),
        *[e.alias(f"__{s}_{n}") for n, p in ranks.items() for s, e in (("f", at(F.floor(p))), ("c", at(F.ceil(p))))])
    out = []
    for n, p in ranks.items():
        a, b = F.col(f"__f_{n}"), F.col(f"__c_{n}")
        out.append(F.when((a == b) | (F.floor(p) == F.ceil(p)), a)
                   .otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b).alias(n))
    return picked.select(*by, *out)


def grouped_mode(df: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """``by`` + the most frequent non-null value (ties: the smallest), null for groups without one."""
    counts = df.select(*by, value.alias("__v")).groupBy(*by, "__v").agg(F.count("__v").alias("__c"))
    # among equal counts the smallest value: min of (-count, value)
    return counts.groupBy(*by).agg(F.min(F.when(F.col("__v").isNotNull(), F.struct((-F.col("__c")).alias("c"), "__v")))["__v"].alias(out))


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of two tables with one row per group, null keys included."""
    by = list(by)
    if not by:
        return left.crossJoin(right)                  # one row each
    named = right.select(*[F.col(c).alias(f"__j_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__j_{c}"))
    return left.join(named, same, "left").drop(*[f"__j_{c}" for c in by])

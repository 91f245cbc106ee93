"""Query registry: name -> (spark builder, oracle SQL or None).

Spark builders take ``(spark, sf_dir)`` and return a lazy DataFrame.  Output
columns are normalised for the cross-engine check by :func:`for_check`
(money DECIMAL -> DOUBLE, DATE -> 'YYYY-MM-DD', TIMESTAMP -> text, string
arrays -> '|'-joined text); the SQL side spells the same conversions out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doc: str = ""):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return for_check(fn(spark, sf_dir))
        REGISTRY[name] = Query(name, build, sql, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def for_check(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from ledgerlens.plans import (q_rules, q_analytics, q_scoring, q_report, q_portfolio,  # noqa: F401
                                  q_cashflow, q_standardize, q_text, q_ml, q_stream, q_misc, q_extras, q_io, q_keys, q_more)
    return REGISTRY

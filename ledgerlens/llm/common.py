"""What the operators share: input tables, stage tables in the shared folder, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_dir

#: White space that separates words, as code points and as a pattern.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for one stage table below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends
    there, so a lost executor only costs its own tasks of the reading stage."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(text: str = "text") -> Column:
    """With the id, tells rows with a repeated id apart (equal rows share it)."""
    return F.xxhash64(F.col(text)).alias("text_hash")


def lower_ascii(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def salted_rows(n: int, rows_per_part: int, least: int = 1) -> int:
    """How many parts hold ``n`` rows at ``rows_per_part`` each."""
    return max(least, -(-n // rows_per_part))


def unused(columns, *names: str) -> list[str]:
    """Names like ``names`` that are none of ``columns`` (compared as Spark does, without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``; the last adds the mix's columns to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, linededup, mixing, simhash, toxicity
from ledgerlens.llm.common import staged, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from ``labels`` and the stage's input."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    # a missing score cannot arise, so exactly the rejected documents go
    score, spans = unused(docs.columns, "score", "spans")
    return toxicity.score(docs, model, (score, spans)).filter(F.col(score) < 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only; texts that lose lines get a new n_chars."""
    names = unused(docs.columns, "kept_text", "n_lines", "n_dropped")
    out = linededup.drop_repeats(docs, min_docs=5, min_chars=40, names=tuple(names))
    kept, _, dropped = map(F.col, names)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dropped > 0, F.char_length(kept).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(dropped > 0, kept).otherwise(F.col("text"))).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every SimHash component."""
    return simhash.first_of_each(docs, shingle=3, bits=3).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order with size, source_size, target, taken, epochs and position."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: XXH64 fingerprints and a trained field cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

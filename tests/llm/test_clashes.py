"""Columns named like what operators and stages use inside, and like their results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import decontaminate, linededup, mixing
from ledgerlens.llm.common import table, unused

SF = "/root/testdata/sf0.001"
NAMES = ["_id", "_hash", "_dropped", "_lines", "_cuts", "n_lines", "n_dropped", "kept_text", "text_hash", "line_no", "slope", "_slope", "_key",
         "_bucket", "_source", "_b", "_ahead", "_inside", "words", "weight", "cap", "level", "_hits0", "contaminated_by", "items", "score",
         "spans", "print", "_print", "first", "root", "component_id", "_row", "h", "n", "lo", "hi"]
RESULTS = {"size", "source_size", "target", "taken", "epochs", "position"}


def wide(docs):
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def docs(spark):
    return wide(table(spark, SF, "documents").limit(120)).cache()


def unchanged(got, but=()):
    for r in got:
        assert all(r[c] == f"{c}{r['doc_id']}" for c in NAMES if c not in but)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_give_back_the_columns(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert set(docs.columns) <= set(out.columns) and (name == "mixing" or out.columns == docs.columns)
    got = out.collect()
    assert got
    unchanged(got)


def test_operators_keep_the_columns(spark, docs):
    unchanged(linededup.drop_repeats(docs).collect(), {"kept_text", "n_lines", "n_dropped"})
    unchanged(mixing.mix_sources(docs).collect())
    unchanged(decontaminate.mark(docs, table(spark, SF, "benchmark")).collect(), {"contaminated_by"})
    assert mixing.mix_sources(docs.withColumn("size", F.lit("x"))).schema["size"].dataType.simpleString() == "bigint"


def test_unused_names():
    assert unused(["a", "B", "a_"], "a", "b", "c", "c") == ["a__", "b_", "c", "c_"]

"""Findings of round 3: what the joins carry, cells of repeats, statement files, parts of a training set."""
import random

from pyspark.sql import functions as F

from helpers import at, txn_rows
from ledgerlens.config import Config
from ledgerlens.operators import rules as R
from ledgerlens.operators import scoring as S


def _plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_row_features_are_derived_behind_the_joins(spark):
    df = txn_rows(spark, [{"ts": at(s), "amount": 10 + s, "balance": 100} for s in range(0, 300, 60)])
    for scored, derived in ((S.score_transactions(df), (" AS log_amount#", " AS balance_utilization#", " AS time_hour#")),
                            (R.rule_engine(df), (" AS time_hour#",))):
        lines = _plan(scored)
        join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
        for name in derived:
            assert any(name in line for line in lines[:join]), name


def test_repeats_reach_over_cells_of_every_size(spark):
    draw = random.Random(5)
    rows = [{"ts": at(draw.randrange(0, 12 * 86400, 21600)), "mode": draw.choice("AB"),
             "amount": draw.choice([0, -1, 1]) * draw.choice([1, 4, 5, 75, 80, 100, 125, 4000, 5000])} for _ in range(150)]
    for tol in (0.0, 0.02, 0.25, 0.8, 1.5):
        cfg = Config.fixture().with_(repeated_tolerance=tol)
        got = {r.seq: r.repeat_partners for r in R.repeated_counts(R.prepare(txn_rows(spark, rows), cfg), cfg).collect()}
        for i, r in enumerate(rows):
            near = lambda s: (s["amount"] == 0 if r["amount"] == 0 else
                              abs(float(r["amount"]) - s["amount"]) / abs(float(r["amount"])) <= tol)
            assert got[i] == sum(1 for j, s in enumerate(rows) if j != i and s["mode"] == r["mode"] and near(s)
                                 and abs((s["ts"] - r["ts"]).total_seconds()) <= 86400), (tol, r)


def test_a_repeat_probes_few_cells(spark):
    df = txn_rows(spark, [{"ts": at(21600 * i), "amount": 1 + 37 * i % 900, "mode": "A"} for i in range(400)])
    cfg = Config.fixture()
    counts = R.repeated_counts(R.prepare(df, cfg), cfg)
    counts.count()
    assert any("sequence(" in line for line in _plan(counts))      # cells of the row's own reach, not all nine around


def test_statement_files_are_about_one_per_account(spark, tmp_path):
    from ledgerlens.sources import statements as SS
    raw = spark.range(800).select((F.col("id") % 20).alias("account_id"), F.col("id").alias("seq"),
                                  F.col("id").cast("string").alias("txnId")).repartition(8)
    path = str(tmp_path / "statements")
    SS.write_statements(raw, path)
    files = list((tmp_path / "statements").glob("account_id=*/*.csv"))
    assert len({f.parent for f in files}) == 20 and len(files) <= 20 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["txnId", "account_id"] and back.count() == 800


def test_training_rows_are_dealt_by_their_number(spark):
    from ledgerlens.operators import ml as ML
    rows = spark.range(1000).withColumnRenamed("id", "seq").coalesce(1)
    assert ML.dealt(rows, 100).rdd.getNumPartitions() == 10 and ML.dealt(rows, 100).count() == 1000
    assert ML.dealt(rows, 1000).rdd.getNumPartitions() == 1


def test_ids_are_read_without_a_python_object_for_each_list_element():
    import pyarrow as pa
    from ledgerlens.llm.pieces import _id_lists
    column = pa.array([[9], [1, 2], None, [], [3]], type=pa.list_(pa.int32()))
    assert _id_lists(column[1:]) == [[1, 2], [], [], [3]] and _id_lists(column[:0]) == []


def test_plain_normal_form_equals_that_by_units(monkeypatch):
    from ledgerlens.llm import pieces as P
    texts = ["", " ", "   ", "a", " a  b ", "é  ü\n", "\u2581x \u2581", "日本 語 ", "a\tb  "]
    for settings in (P.Settings(), P.Settings(trim_spaces=False), P.Settings(mark_after=True), P.Settings(dummy_prefix=False),
                     P.Settings(mark_spaces=False)):
        plain = [P.Normalizer(settings)(t.encode()) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(P, "_offsets", lambda raw: None)
            units = [P.Normalizer(settings)(t.encode()) for t in texts]
        assert [(a, list(b)) for a, b in plain] == [(a, list(b)) for a, b in units]

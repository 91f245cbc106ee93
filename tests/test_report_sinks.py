"""Report documents, candidate columns and stored sketches on small tables."""
import tempfile

from pyspark.sql import functions as F

from ledgerlens.operators import analytics as A
from ledgerlens.operators import features as FE
from ledgerlens.sources import statements as SS


def test_report_has_every_module_and_key(spark):
    a = spark.createDataFrame([(1, 2.5, ["x"]), (2, None, [])], "account_id long, total double, names array<string>")
    b = spark.createDataFrame([(2, "High"), (3, "Low")], "account_id long, risk string")
    path = tempfile.mkdtemp(prefix="report-")
    master = {r["account_id"]: r for r in SS.write_report({"statistics": a, "cashflow": b}, path).collect()}
    assert sorted(master) == [1, 2, 3]
    assert master[1]["statistics"]["total"] == 2.5 and master[1]["statistics"]["names"] == ["x"] and master[1]["cashflow"] is None
    assert master[2]["cashflow"]["risk"] == "High" and master[3]["statistics"] is None
    assert {r["account_id"] for r in spark.read.json(f"{path}/cashflow").collect()} == {2, 3}


def test_first_candidate_counts_and_day_takes_its_time(spark):
    d = spark.createDataFrame([("1,500", "2024-03-02", "10:20:30", "shop", "pos"), (None, "no date", None, None, None)],
                              "`Transaction Amount` string, TransactionDate string, Time string, MerchantID string, Channel string")
    d = d.withColumn("description", F.lit("later candidate"))
    rows = FE.row_features(d).collect()
    assert (rows[0]["amount_f"], rows[0]["hour"], rows[0]["month"], rows[0]["merchant"]) == (1500.0, 10, 3, "shop")
    assert (rows[0]["mode"], rows[0]["transaction_type"], rows[0]["balance_after"]) == ("pos", "pos", 999999.0)
    assert (rows[1]["amount_f"], rows[1]["hour"], rows[1]["ts"], rows[1]["merchant"]) == (0.0, 12, None, "UNKNOWN")
    assert rows[1]["debit_credit"] == "DEBIT" and rows[1]["narration"] == "later candidate"


def test_sketches_merge_over_months(spark):
    d = spark.range(60_000).select(
        (F.col("id") % 2).alias("account_id"), F.expr("date_add(DATE '2024-01-01', cast(id % 120 as int))").alias("date"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 7919).alias("merchant"))
    months = A.distinct_sketches(d, "merchant")
    assert months.count() == 2 * 4
    parts = A.distinct_sketches(d.where("merchant % 3 = 0"), "merchant").unionByName(months)
    exact = {r[0]: r[1] for r in d.where("date BETWEEN '2024-02-01' AND '2024-03-31'").groupBy("account_id").agg(
        F.count_distinct("merchant")).collect()}
    for stored in (months, parts):                   # months stored in parts or twice count once
        got = {r[0]: r[1] for r in A.distinct_in_span(stored, "2024-02", "2024-03").collect()}
        assert all(abs(got[k] - n) <= A.SKETCH_BOUND * n for k, n in exact.items()) and len(got) == 2
    assert A.distinct_in_span(months, "2030-01", "2030-02").count() == 0

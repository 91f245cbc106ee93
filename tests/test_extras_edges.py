"""Dedupe and reconciliation on rows that do repeat and do not add up."""

from helpers import at, txn_rows
from pyspark.sql import functions as F

from ledgerlens.operators import extras as X


def test_dedupe_keeps_one_of_each_id_and_all_without(spark):
    t = txn_rows(spark, [{"ts": at(i), "amount": 10 + i} for i in range(4)])
    later = t.where("seq = 1").withColumn("seq", F.lit(9).cast("long"))
    twin = t.where("seq = 2").withColumn("amount", F.lit(99).cast("decimal(18,2)"))      # same id and place, other amount
    unnamed = t.where("seq < 2").withColumn("txn_id", F.lit(None).cast("string"))
    d = t.unionByName(t).unionByName(later).unionByName(twin).unionByName(unnamed)
    got = sorted((r.txn_id or "", r.seq) for r in X.dedupe_txn(d).collect())
    assert got == [("", 0), ("", 1), ("0", 0), ("1", 1), ("2", 2), ("3", 3)]
    amounts = {tuple(r.amount for r in X.dedupe_txn(x).where("txn_id = '2'").collect()) for x in (d, d.repartition(3))}
    assert len(amounts) == 1                                     # reruns agree
    assert X.dedupe_txn(t.where("false")).count() == 0


def test_reconcile_finds_the_breaks(spark):
    rows = [{"ts": at(i), "amount": 10, "balance": 100 - 10 * i} for i in range(5)]
    rows[3]["balance"] = 71
    r = X.reconcile_balance(txn_rows(spark, rows)).first()
    assert (r.checked, r.breaks) == (4, 2)

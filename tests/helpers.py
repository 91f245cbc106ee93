import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.sources.tables import CANON


def txn_rows(spark, rows):
    """rows: dicts with any of the canonical fields; defaults fill the rest."""
    base = {"account_id": 1, "txn_id": None, "seq": None, "ts": None, "date": None, "time": None,
            "debit_credit": "Debit", "amount": None, "balance": None, "transaction_type": "UPI",
            "mode": "UPI", "merchant": "SHOP", "narration": "UPI/SHOP"}
    out = []
    for i, r in enumerate(rows):
        d = dict(base, **r)
        d["seq"] = d["seq"] if d["seq"] is not None else i
        d["txn_id"] = str(d["seq"])
        if d["ts"] is not None and d["date"] is None:
            d["date"] = d["ts"].date()
        if d["ts"] is not None and d["time"] is None:
            d["time"] = d["ts"].strftime("%H:%M:%S")
        out.append(d)
    schema = ("account_id long, txn_id string, seq long, ts timestamp, date date, time string, "
              "debit_credit string, amount decimal(18,2), balance decimal(18,2), transaction_type string, "
              "mode string, merchant string, narration string")
    import decimal
    for d in out:
        for k in ("amount", "balance"):
            if d[k] is not None:
                d[k] = decimal.Decimal(str(d[k]))
    return spark.createDataFrame([tuple(d[c] for c in CANON) for d in out], schema)


T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)

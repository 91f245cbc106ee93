"""Rectangle sums and the repeat rule that counts with them, against plain counting."""

import random

import numpy as np
import pytest
from helpers import at, txn_rows
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.functions.dominance import corner_sums, from_order_key, order_key, rectangle_sums, tolerance_keys
from ledgerlens.operators import rules as R


def test_corner_sums_equal_plain_sums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 64, 257):
        u, v, w = (rng.integers(0, 20, n) for _ in range(3))
        qu, qv = rng.integers(-2, 23, 50), rng.integers(-2, 23, 50)
        want = [int(w[(u <= a) & (v <= b)].sum()) for a, b in zip(qu, qv)]
        assert corner_sums(u, v, w, qu, qv).tolist() == want


def test_tolerance_keys_are_the_outermost_doubles():
    a = np.array([0.0, 1.0, -3.7, 99.99, 1e-9, 12345.67, -0.01])
    assert (from_order_key(order_key(a)) == a).all()
    for tol in (0.0, 0.02, 0.25, 0.999, 1.0, 2.5):
        lo, hi = tolerance_keys(a, tol)
        assert lo[0] == hi[0] == 0
        x = a[1:]
        for k, step in ((lo[1:], -1), (hi[1:], 1)):
            assert (np.abs(x - from_order_key(k)) / np.abs(x) <= tol).all()
            assert (np.abs(x - from_order_key(k + step)) / np.abs(x) > tol).all()


@pytest.mark.parametrize("tile_rows,cuts", [(10_000, 4), (40, 4), (25, 16)])
def test_rectangles_over_tiles(spark, tile_rows, cuts):
    rng = random.Random(7)
    # cell 1: spread; cell 2: one u for half of the points, few values of v; cell 3: small; cell 4: no query
    pts = ([(1, rng.randrange(1000), rng.randrange(1000), rng.randrange(1, 4)) for _ in range(400)]
           + [(2, 500 if rng.random() < 0.5 else rng.randrange(1000), rng.randrange(3), 1) for _ in range(400)]
           + [(3, 5, 5, 2)] + [(4, 1, 1, 1)])
    qs = []
    for i in range(300):
        lo, hi = sorted((rng.randrange(-50, 1050), rng.randrange(-50, 1050)))
        b, t = sorted((rng.randrange(-50, 1050), rng.randrange(-50, 1050))) if i % 2 else sorted((rng.randrange(4), rng.randrange(4)))
        qs.append((rng.choice([1, 1, 2, 2, 3, 9]), i, lo, hi, b, t))
    got = rectangle_sums(spark.createDataFrame(pts, "c long, u long, v long, w long"),
                         spark.createDataFrame(qs, "c long, id long, u_lo long, u_hi long, v_lo long, v_hi long"),
                         ["c"], ["id"], "s", tile_rows, cuts)
    got = {r.id: r.s for r in got.collect()}
    for c, i, lo, hi, b, t in qs:
        want = sum(w for pc, u, v, w in pts if pc == c and lo <= u <= hi and b <= v <= t)
        assert got.get(i, 0) == want, (c, i)


def _brute(rows, cfg):
    w = cfg.repeated_window_hours * 3600
    sec = np.array([(r["ts"] - at(0)).total_seconds() for r in rows])
    amt = np.array([float(r["amount"]) for r in rows])
    out = []
    for s, a in zip(sec, amt):
        with np.errstate(all="ignore"):
            ok = (np.abs(a - amt) / abs(a) <= cfg.repeated_tolerance) if a != 0 else amt == 0
        out.append(int(((np.abs(sec - s) <= w) & ok).sum()) - 1)
    return out


@pytest.mark.parametrize("tol", [0.0, 0.02, 0.6, 1.5])
def test_dense_cells_equal_brute_force(spark, tol):
    """Near-equal amounts of one key over three days, copies, equal amounts at many times, many
    amounts at one time, zeros and negatives: every cell counted by rectangles, by pairs, and by both."""
    rng = random.Random(3)
    rows = ([{"ts": at(rng.randrange(0, 200_000)), "amount": round(rng.uniform(95, 105), 2)} for _ in range(250)]
            + [{"ts": at(rng.randrange(0, 200_000)), "amount": 100.0} for _ in range(100)]
            + [{"ts": at(86_400), "amount": round(rng.uniform(-103, 103), 2)} for _ in range(100)]
            + [{"ts": at(rng.randrange(0, 90_000)), "amount": 0.0} for _ in range(20)])
    cfg = Config(repeated_key="merchant", repeated_tolerance=tol)
    want = _brute(rows, cfg)
    df = txn_rows(spark, rows)
    for dense_rows, tile_rows, cuts in ((0, 30, 8), (40, 1000, 8)):
        got = {r["seq"]: r["repeat_partners"] for r in
               R.repeated_counts(df, cfg, dense_rows, tile_rows, cuts).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_one_hot_key_grows_without_pairs(spark):
    """60,000 near-equal amounts of one key within a day (3.6e9 pairs)."""
    n = 60_000
    t = spark.range(n, numPartitions=4).select(
        F.lit(1).cast("long").alias("account_id"), F.col("id").alias("seq"), F.lit("SHOP").alias("merchant"),
        F.timestamp_micros(F.col("id") * 1_000_000 + 1_704_067_200_000_000).alias("ts"),
        (F.lit(1000) + F.col("id") % 10).cast("decimal(18,2)").alias("amount"))
    r = R.repeated_counts(t, Config(repeated_key="merchant"), tile_rows=8_000, cuts=16)
    got = r.agg(F.count("*").alias("n"), F.min("repeat_partners").alias("lo"), F.max("repeat_partners").alias("hi")).first()
    assert (got.n, got.lo, got.hi) == (n, n - 1, n - 1)

"""Hard negatives against a plain search over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hardnegatives
from ledgerlens.llm.hardnegatives import Best, Lists, Mining, search

SCHEMA = "vec_id long, label int, embedding array<double>, id string, h string, v string, score string"


def brute(rows, positives=5, negatives=3, every=50):
    ok, known = [], set()
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * x) for x in v)
        if (i, label, v) not in known:
            known.add((i, label, v))
            ok.append((i, label, v))
    out = []
    late = lambda i: (i is None, i or 0)
    for a in ok:
        if a[0] is None or a[0] % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2])), r) for r in ok if r != a and len(r[2]) == len(a[2])),
                        key=lambda x: (-x[0], late(x[1][0])))
        for p, pos in [x for x in scored if x[1][1] == a[1]][:positives]:
            fit = [x for x in scored if x[1][1] != a[1] and 50 * p <= 100 * x[0] <= 95 * p]
            out += [(a[0], pos[0], n + 1, neg[0], p, s) for n, (s, neg) in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def run(spark, rows, m=Mining(), every=50):
    wide = [(*r, "a", "b", "c", "d") for r in rows]
    got = hardnegatives.mine(spark.createDataFrame(wide, SCHEMA), F.col("id") % every == 0, m).collect()
    return sorted((tuple(r) for r in got), key=str)


def some(n, seed, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, int(rng.integers(0, 4)), [float(x) for x in np.round(centres[i % 5] + rng.normal(size=dims) * 0.5, 1)]) for i in range(n)]


@pytest.mark.parametrize("m", [Mining(), Mining(block_rows=17, block_anchors=3, first_depth=1), Mining(block_values=60)])
def test_all_rows_against_brute(spark, m):
    rows = some(160, 1)
    assert run(spark, rows, m, 10) == brute(rows, every=10)


def test_nulls_copies_lengths_and_large_values(spark):
    rows = some(60, 2, 3)
    rows += [(100, None, [1.0, 1.0, 1.0]), (150, 1, None), (None, 1, [1.0, 2.0, 3.0]), (None, 2, [1.0, 2.0, 2.0]), (200, 1, []), (201, 1, []),
             (202, 2, []), (250, 1, [float("nan"), 1.0, 1.0]), (300, 1, [None, 1.0, 1.0]), (350, 1, [float("inf"), 1.0, 1.0]),
             (400, 1, [0.0, 0.0, 0.0]), (450, 1, [1.0, 2.0]), (451, 1, [1.0, 2.5]), (452, 2, [1.0, 1.5]),
             (500, 1, [3e6, -3e6, 1e5]), (501, 1, [3e6, -3e6, 0.3e5]), (502, 2, [2e6, -2e6, 1e5]), (503, 3, [2.5e6, -2e6, 1e5]),
             (550, 1, [1.0, 0.5, 0.25])] + [(551, 1, [1.0, 0.5, 0.25])] * 3 + [(i, 2, [0.9, 0.5, 0.25]) for i in range(600, 640)]
    got = run(spark, rows, Mining(block_rows=20))
    assert got == brute(rows) and any(r[0] == 500 for r in got) and any(r[0] == 400 for r in got)
    assert run(spark, [], Mining()) == []


def test_stops_before_the_end():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 3)).round(2)
    lists, q = Lists(np.floor(256 * x)), np.array([300.0, -200.0, 0.0])
    best = Best(5, np.arange(4000), np.ones(4000, dtype=bool))
    assert search(lists, q, best, 16) <= 128
    assert list(best.rows) == sorted(range(4000), key=lambda i: (-(lists.x[i] @ q), i))[:5]


def test_a_tie_at_the_bound_is_settled():
    lists = Lists(np.array([[5.0, 5.0], [5.0, 5.0], [5.0, 5.0], [1.0, 1.0]]))
    best = Best(1, np.array([3, 2, 1, 0]), np.ones(4, dtype=bool))
    search(lists, np.array([1.0, 1.0]), best, 1)
    assert list(best.rows) == [2]

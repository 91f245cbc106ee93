"""Carry, halo and range helpers against plain Python, also where buckets are tiny, sparse or hot."""
import random

from pyspark.sql import functions as F

from ledgerlens.functions.windows import carried, neighbours, range_parts
from ledgerlens.operators import textlines as TL
from ledgerlens.operators.ml import eval_binary
from ledgerlens.operators.standardize import dense_codes


def _rows(seed, n=400):
    rnd = random.Random(seed)
    lines = sorted(rnd.sample(range(4000), n))
    return [(d, x, rnd.choice([None, None, f"v{x}"]), rnd.randint(0, 1)) for d in ("a", "b", None) for x in lines]


def test_carried_equals_a_plain_walk(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "doc string, n long, v string, c int")
    got = carried(df, ["doc"], F.floor(F.col("n") / 7), ["n"], {"upto": F.col("v"), "past": F.col("v")},
                  {"seen": F.col("c")}, before=["past"]).collect()
    assert len(got) == len(rows)
    state = {}
    want = {}
    for d, n, v, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last, total = state.get(d, (None, 0))
        state[d] = (v if v is not None else last, total + c)
        want[d, n] = (state[d][0], last, state[d][1])
    assert {(r["doc"], r["n"]): (r["upto"], r["past"], r["seen"]) for r in got} == want


def test_neighbours_reach_over_short_buckets(spark):
    rows = [(d, n, f"t{n}") for d, n, _, _ in _rows(2)] + [("one", 5, "t5"), ("two", 1, "t1"), ("two", 900, "t900")]
    df = spark.createDataFrame(rows, "doc string, n long, t string")
    for width in (3, 50, 10_000):
        got = neighbours(df, ["doc"], F.floor(F.col("n") / width), ["n"], "t", 2, 3).collect()
        assert len(got) == len(rows)
        per = {}
        for d, n, t in rows:
            per.setdefault(d, []).append((n, t))
        at = {}
        for d, ls in per.items():
            ls = [t for _, t in sorted(ls)]
            for i, t in enumerate(ls):
                at[d, t] = [ls[j] if 0 <= j < len(ls) else None for j in (i - 1, i - 2, i + 1, i + 2, i + 3)]
        for r in got:
            assert [r[c] for c in ("prev_1", "prev_2", "next_1", "next_2", "next_3")] == at[r["doc"], r["t"]]


def test_helpers_on_no_rows(spark):
    df = spark.createDataFrame([], "doc string, n long, t string")
    assert carried(df, ["doc"], F.col("n"), ["n"], {"x": F.col("t")}, {"k": F.lit(1)}).count() == 0
    assert neighbours(df, ["doc"], F.col("n"), ["n"], "t", 1, 2).count() == 0
    assert range_parts(df, "t", "part").count() == 0


def test_parts_are_even_whatever_the_values_share(spark):
    n = 1_000_000
    d = spark.range(n).select(F.format_string("merchant_%07d", "id").alias("v"), (F.col("id") / 1e12).alias("s"))
    for col in ("v", "s"):
        sizes = [r["count"] for r in range_parts(d.select(col), col, "part").groupBy("part").count().collect()]
        assert sum(sizes) == n and max(sizes) < 3 * n / 256


def test_codes_of_one_prefix_are_the_ranks(spark):
    d = spark.range(30_000).select(F.format_string("m_%06d", F.col("id") * 7 % 30_000).alias("v"))
    d = d.unionByName(spark.createDataFrame([(None,), ("",), ("m_",)], "v string"))
    got = {r["v"]: r["code"] for r in dense_codes(d, "v", "code").collect()}
    want = sorted((v for v in got if v is not None))
    assert got[None] == 0 and [got[v] for v in want] == list(range(1, len(want) + 1))


def test_auc_of_scores_near_zero(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3000) / 1e9, rnd.randint(0, 1)) for _ in range(3000)]
    got = eval_binary(spark.createDataFrame(rows, "s double, is_fraud int"), "s", "is_fraud").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(got["roc_auc"] - auc) < 1e-9


def test_context_of_a_long_document(spark):
    """Ten thousand lines of one document give what they give one by one, over bucket borders too."""
    n = 10_000
    lines = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("line_no"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("01-02-2024 UPI SHOP"), F.col("id").cast("string")))
        .when(F.col("id") % 3 == 2, F.format_string("1,%03d.00", F.col("id") % 1000)).otherwise("plain words").alias("text"))
    got = {r["line_no"]: r["amount"] for r in TL.parse_context(lines).collect()}
    # a dated line finds its amount two lines below; the last one has none
    assert got == {i: 1000.0 + (i + 2) % 1000 for i in range(0, n - 2, 3)}


def test_layout_lines_before_any_start_and_of_a_long_block(spark):
    rows = ([(1, 1, i, 1.0 * i, "", "loose words", None) for i in range(5000)]
            + [(1, 1, 5000, 5000.0, "01 Feb 24", "UPI/1/2/SHOP", "100.00"), (1, 1, 5001, 5001.0, "", "more", None),
               (1, 2, 9000, 1.0, "", "PURCHASE X", "40.00"), (1, 2, 9500, 2.0, "02 Feb 24", "TOTAL", "40.00")])
    lay = spark.createDataFrame(rows, "doc_id long, page int, line_no long, y double, date_text string, desc_text string, balance_text string")
    got = sorted((r["first_line"], r["debit_credit"], r["amount"], r["date"]) for r in TL.parse_layout(lay).collect())
    assert got == [(5000, "", None, "01 Feb 24"), (9000, "DEBIT", 60.0, "")]

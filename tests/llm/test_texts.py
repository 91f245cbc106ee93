"""Substring dedup, line dedup, SimHash and decontamination against plain Python versions."""

import numpy as np
import pytest

from ledgerlens.llm import decontaminate, linededup, simhash, substringdedup
from ledgerlens.llm.components import connected
from ledgerlens.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.hard_docs(), brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in brute.hard_docs()]


def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_substring_brute(docs, plain):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept_text"]))
           for r in substringdedup.remove_repeats(docs).collect()}
    assert got == brute.substring(plain)


@pytest.mark.parametrize("window,gram", [(5, 2), (8, 3), (8, 8)])
def test_substring_random(spark, window, gram):
    rng = np.random.default_rng(window + gram)
    rows = []
    for d in range(60):
        w = [str(x) for x in rng.integers(0, 4, rng.integers(0, 120))]
        rows.append((d * 7 % 61, " ".join(w)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept_text"]))
           for r in substringdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, gram).collect()}
    assert got == brute.substring(rows, window)


def test_substring_spans_and_repeats(spark):
    p = " ".join(brute.sentence(60, 9))
    rows = [(2, "a " + p + " b", 1, "x"), (1, p, 1, "x"), (2, "a " + p + " b", 1, "x"), (None, p, 1, "x"), (3, None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, anchor string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], [tuple(s) for s in r["removed"]])
                  for r in substringdedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 60, 0, []), (2, 62, 60, [(1, 61)]), (2, 62, 60, [(1, 61)]), (3, 0, 0, []), (None, 60, 0, [])], key=str)
    assert substringdedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (4, 2), (7, 3)])
def test_lines_brute(docs, plain, batches, fan_out):
    out = linededup.drop_repeats(docs.withColumn("n_lines", F.lit("clash")), n_batches=batches, fan_out=fan_out)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()}
    assert got == brute.line_dedup(plain)
    assert {"lang", "source", "n_chars"} <= set(out.columns)


def test_lines_null_ids_and_repeats(spark):
    long = "x" * 40
    rows = [(None, long)] * 6 + [(1, long), (1, long), (2, long), (3, long), (4, long)]
    got = linededup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0")
    assert got.count() == 0                        # four ids only, however many rows
    rows += [(5, long), (5, "\n" + long)]
    got = linededup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.sum("n_dropped"))
    assert {tuple(r) for r in got.collect()} == {(None, 0), (1, 2), (2, 1), (3, 1), (4, 1), (5, 0)}
    assert linededup.drop_repeats(empty(spark)).count() == 0


def test_simhash_brute(docs, plain):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.simhash(plain)


def flipped(n, seed):
    """Random prints, each with relatives a few bits away."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    out = [base]
    for _ in range(3):
        x = base.copy()
        for _ in range(rng.integers(1, 5)):
            x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


def near_pairs(prints, bits=3):
    return {(int(a), int(b)) for i, a in enumerate(prints) for b in prints[i + 1:][np.bitwise_count(prints[i + 1:] ^ a) <= bits]}


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_finds_all_pairs(budget):
    prints = flipped(300, budget)
    group = np.zeros(len(prints), dtype=np.int64)
    got = [p for i, j in simhash.trie_links(prints, group, budget) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got))
    assert {(int(prints[i]), int(prints[j])) for i, j in got} == near_pairs(prints, budget)


@pytest.mark.parametrize("task_rows", [60_000, 20])
def test_print_links_components(spark, monkeypatch, task_rows):
    monkeypatch.setattr(simhash, "TASK_ROWS", task_rows)         # 20: every block is cut again
    monkeypatch.setattr(simhash, "PAIRS", 64)
    clump = np.uint64(0xFFFF0000FFFF0000) ^ (np.uint64(1) << np.arange(48, dtype=np.uint64))
    prints = np.unique(np.concatenate([flipped(150, 5), clump]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    links = simhash.print_links(df)
    of = {r["node"]: r["root"] for r in connected(links).collect()}
    signed = lambda x: int(np.uint64(x).view(np.int64))
    want = brute.components(sorted(map(signed, prints)), [(signed(a), signed(b)) for a, b in near_pairs(prints)])
    assert {k: of.get(k, k) for k in want} == want


def test_simhash_edges(spark):
    rows = [(5, "same text here now"), (3, "Same TEXT  here now"), (None, "same text here now"), (5, "same text here now"),
            (8, None), (7, ""), (9, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, None), (7, 7), (8, 7), (9, 7)], key=str)
    kept = simhash.first_of_each(df).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([3, 7, None], key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7), (900, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}


def items():
    w = brute.sentence(400, 4)
    return [(1, " ".join(w[60:90])), (2, " ".join(w[100:130]).upper()), (3, " ".join(brute.sentence(30, 77))), (4, "two words"),
            (5, ""), (6, None), (7, "one"), (8, " ".join(brute.sentence(60, 1)[:55] + ["x"] * 5)), (3, " ".join(brute.sentence(30, 77))),
            (9, " ".join(brute.sentence(4000, 3)))]


@pytest.mark.parametrize("block", [20_000, 3])
def test_decontamination_brute(spark, docs, plain, block):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    out = decontaminate.mark(docs.withColumn("contaminated_by", F.lit(0)), bench, block_items=block)
    got = {(r["doc_id"], h["item_id"]): (h["n_shingles"], h["n_shared"]) for r in out.collect() for h in r["contaminated_by"]}
    want = brute.contaminated(plain, items())
    assert got == want and len(want) > 5
    assert decontaminate.clean(docs, bench).count() == len(plain) - len({d for d, _ in want})


def test_decontamination_every_edit_count(spark):
    """Passages with more and more words changed: found exactly down to the share."""
    w = brute.sentence(45, 6)
    rows = []
    for k in range(12):
        v = list(w)
        for i in range(k):
            v[i * 4] = "zz"
        rows.append((k, " ".join(brute.sentence(300, 50 + k) + v + brute.sentence(300, 80 + k))))
    bench = [(1, " ".join(w)), (2, " ".join(w[:9])), (3, " ".join(w[:5]))]
    got = decontaminate.contaminated_pairs(spark.createDataFrame(rows, "doc_id long, text string"),
                                           spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in got} == brute.contaminated(rows, bench)


def test_decontamination_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_pairs(docs, none).count() == 0
    assert decontaminate.contaminated_pairs(empty(spark), spark.createDataFrame(items(), "item_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr)
    sql = duck.execute(ORACLES[name])
    names = [d[0] for d in sql.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=repr)
    assert sorted(names) == sorted(got.columns) and len(rows) == len(want)
    for a, b in zip(rows, want):
        assert a == pytest.approx(b, rel=1e-12) if any(isinstance(x, float) for x in a) and None not in a else a == b


def test_simhash_keeps_every_text_of_a_repeated_id(spark):
    text = {k: " ".join(brute.sentence(80, 700 + k)) for k in range(5)}
    rows = [(6, text[0], "a"), (6, text[1], "a"), (5, text[2], "a"), (5, text[3], "a"), (3, text[3], "a"), (6, text[0], "a"),
            (9, text[4], "a"), (9, text[4], "b")]
    want = sorted([(6, text[0]), (6, text[1]), (5, text[2]), (3, text[3]), (9, text[4])])
    seen = set()
    for n in range(1, 4):
        df = spark.createDataFrame(rows[n:] + rows[:n], "doc_id long, text string, source string").repartition(n)
        got = simhash.first_of_each(df).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == want
        seen.add(next(r["source"] for r in got if r["doc_id"] == 9))
    assert len(seen) == 1

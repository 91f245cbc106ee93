"""Toxicity, quality and token counts: brute force, round trips and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality, tokencounts, toxicity
from ledgerlens.llm.queries import QUERIES, RANK_FILE
from ledgerlens.llm.textarrays import Words, sliding_min, utf8

import brute

SF = "/root/testdata/sf0.01"


def marginals(emission, trans):
    """All tag sequences of one text."""
    n, total, on = len(emission), 0.0, np.zeros(len(emission))
    for tags in itertools.product((0, 1), repeat=n):
        s = (toxicity.START if tags[0] else 0.0) + sum(e for e, t in zip(emission, tags) if t)
        s += sum(trans[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(s)
        on += np.exp(s) * np.array(tags)
    return on / total


@pytest.mark.parametrize("block", [2, 3, 128])
def test_forward_backward_brute(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(block)
    trans = np.log(np.array([[0.9, 0.1], [0.35, 0.65]]))
    lengths = [1, 7, 2, 9, 1, 5]
    emission = rng.normal(0, 2, sum(lengths))
    first, last = np.zeros(len(emission), bool), np.zeros(len(emission), bool)
    ends = np.cumsum(lengths)
    first[ends - lengths], last[ends - 1] = True, True
    p, _, _ = toxicity.forward_backward(emission, first, last, trans)
    want = np.concatenate([marginals(emission[e - n:e], trans) for n, e in zip(lengths, ends)])
    assert np.allclose(p, want, atol=1e-12)


def test_forward_backward_long_and_extreme():
    n = 50_000
    emission = np.where(np.arange(n) % 7 == 0, 30.0, -30.0)
    ends = np.zeros(n, bool)
    first, last = ends.copy(), ends.copy()
    first[0] = last[-1] = True
    p, _, _ = toxicity.forward_backward(emission, first, last, np.log(np.array([[0.99, 0.01], [0.5, 0.5]])))
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all() and p[0] > 0.99 and p[1] < 0.01


def test_toxicity_held_out(spark):
    out = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(out) == docs.count()
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(d, t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(out[d]["held_out"] for d, _ in held) and {r["held_out"] for r in out.values()} == {True, False}
    right = sum(out[d]["predicted"] == t for d, t in held)
    assert right >= 0.95 * len(held)
    assert not [d for d, t in held if t == 0 and out[d]["predicted"]]


def toxic_texts(n=160):
    rng = random.Random(1)
    bad = ["grimblat", "grimblor", "Grimblex", "vornak"]
    rows = []
    for d in range(n):
        w = ["%x" % rng.randint(0, 5000) + rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(5, 60))]
        toxic = int(d % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((d, " ".join(w), toxic))
    return rows


def test_toxicity_spans_and_edges(spark):
    rows = toxic_texts()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(0, 1, 0), (10 ** 6, 1, 1), (None, 1, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit_on(docs, labels)
    text = "Ünïcode alpha, grimblat grimblunseen! beta " + "gamma " * 3000 + "vornak."
    hard = spark.createDataFrame([(1, text, "x"), (None, text, "x"), (2, None, None), (3, "", "x"), (4, " .,! ", "x"),
                                  (5, "alpha " * 30000, "x"), (1, text, "x")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"] or -1, round(r["score"], 9), [(s["start"], s["end"]) for s in r["spans"]])
                 for r in toxicity.score(hard, model).collect())
    found = [text.index("grimblat"), text.index("grimblunseen") + len("grimblunseen")], text.index("vornak")
    high = [g for g in got if g[0] in (-1, 1)]
    assert len(high) == 3 and len({(g[1], tuple(g[2])) for g in high}) == 1
    assert high[0][1] > 0.9 and high[0][2] == [tuple(found[0]), (found[1], found[1] + 6)]
    low = [g for g in got if g[0] > 1]
    assert all(g[1] < 0.5 and not g[2] for g in low) and len({g[1] for g in low[:3]}) == 1
    none = toxicity.fit_on(docs, labels.filter("toxic = 0"))
    assert none.empty and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit_on(docs.limit(0), labels).empty and toxicity.fit_on(docs, labels.limit(0)).empty


def test_toxicity_never_fits_on_held_out_rows(spark):
    """Words that are toxic in held-out rows only are not learned."""
    rows = [(d, t, y) for d, t, y in toxic_texts(400)]
    held = [zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows]
    rows = [(d, "secretword secretwood " + t if h else t, 1 if h else y) for (d, t, y), h in zip(rows, held)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit_on(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    one = spark.createDataFrame([(1, "secretword alpha secretwood beta"), (2, "grimblat alpha")], "doc_id long, text string")
    assert [r["score"] >= 0.5 for r in toxicity.score(one, model).orderBy("doc_id").collect()] == [False, True]


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    accuracy, coverage = [0.95, 0.8, 0.9, 0.7, 0.85], [1, 0.8, 0.5, 0.9, 0.7]
    votes = np.stack([np.where(rng.random(len(truth)) < c, np.where(rng.random(len(truth)) < a, truth, ~truth).astype(int), -1)
                      for a, c in zip(accuracy, coverage)], axis=1)
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(pattern, count.astype(float))
    assert abs(model.share - 0.8) < 0.03 and np.abs(model.accuracies() - accuracy).max() < 0.03
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.95


def test_quality_held_out(spark):
    out = {r["doc_id"]: r["predicted"] for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert len(out) == 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()       # never read by the operator
    assert sum(out[r["doc_id"]] == r["quality"] for r in labels) >= 0.95 * len(labels)


def test_quality_edges(spark):
    good = [(i, ". ".join(" ".join(brute.sentence(12, i * 50 + k)).capitalize() for k in range(6)) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(x.upper() + "!!" for x in brute.sentence(70, 5000 + i))) for i in range(20)]
    bad += [(130 + i, " ".join(x for x in brute.sentence(6, 7000 + i) for _ in range(20))) for i in range(20)]
    hard = [(None, good[0][1]), (200, None), (201, ""), (202, "   "), (203, bad[0][1]), (203, bad[0][1]), (204, "y " * 50_000)]
    docs = spark.createDataFrame([(*r, "x") for r in good + bad + hard], "doc_id long, text string, score string")
    model = quality.fit(docs)
    got = quality.score(docs, model).collect()
    assert len(got) == len(good + bad + hard)
    of = {r["doc_id"]: r["score"] for r in got}
    assert all(of[i] >= 0.5 for i, _ in good) and all(of[i] < 0.5 for i, _ in bad) and of[204] < 0.5
    assert of[None] == of[0] and of[203] == of[100] and of[200] == of[201] == of[202]
    nothing = quality.fit(docs.limit(0))
    assert quality.score(docs.limit(0), nothing).count() == 0
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


def test_words_match_pattern():
    texts = [r[1] for r in brute.hard_docs()]
    data, at = utf8(pa.array(texts, pa.string()).slice(1))
    w = Words(data, at)
    got = [[bytes(data[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [brute.words(t) for t in texts[1:]]


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 99, 200).astype(np.uint64)
    for n in (1, 2, 3, 7, 41, 64, 200):
        assert sliding_min(x, n).tolist() == [x[i:i + n].min() for i in range(len(x) - n + 1)]


@pytest.fixture(scope="module")
def encode():
    with open(RANK_FILE, "rb") as f:
        enc = tokencounts.encoder(f.read())
    return lambda s: len(enc.encode_ordinary(s))


def test_random_edits(encode):
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "a", "é", "'", "s", "'ll", "9", ".", "!", "word ", " word", "\u3000", "\x1c", "\x85", "\t", "ſ"]
    for text in [r[1] or "" for r in brute.hard_docs() if len(r[1] or "") < 3000] + ["it's  we'll\n\n  x", " " * 50]:
        for leaf in (5, 60):
            c = tokencounts.Counter(encode, leaf, text)
            assert c.tokens[1] == encode(text) and c.chars[1] == len(text)
            for _ in range(15):
                c.edit(rng.randint(0, len(c.text) + 2), rng.choice([0, 1, 2, 5, 50, 400]),
                       "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))))
                assert c.tokens[1] == encode(c.text) and c.chars[1] == len(c.text)


def test_token_query(spark, encode):
    """Every row of the query against texts edited and encoded in full."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    encoded = 0
    for r in got:
        old = texts[r["doc_id"]]
        n, third, late = len(old), len(old) // 3, len(old) * 2 // 3
        new = old[:third] + " revised" + old[:12] + old[third + 24:]
        late = min(late, len(new))
        new = (new[:late] + " and it's added, in 2 places;\n" + new[late:])[40:]
        assert (r["n_tokens_before"], r["n_tokens"], r["n_chars"]) == (encode(old), encode(new), len(new))
        encoded += r["n_encoded"]
    assert encoded < 0.7 * sum(map(len, texts.values()))


def test_edits_table(spark, encode):
    docs = spark.createDataFrame([(1, "alpha beta gamma", 0), (2, None, 0), (3, "", 0), (None, "x y", 0), (1, "alpha beta gamma", 0),
                                  (4, "z " * 20_000, 0)], "doc_id long, text string, tokens int")
    edits = spark.createDataFrame([(1, 2, 0, 5, "omega"), (1, 1, 6, 4, "BETA and"), (2, 1, None, None, "new text"), (3, 1, 99, 5, None),
                                   (None, 1, 0, 1, "no"), (9, 1, 0, 0, "nobody"), (4, 1, 30_000, 10, "middle")],
                                  "doc_id long, edit_no int, start int, length int, insert string")
    out = tokencounts.apply_edits(tokencounts.with_edits(tokencounts.build_trees(docs, RANK_FILE), edits), RANK_FILE).collect()
    got = sorted((r["doc_id"] or -1, r["text"][:40], r["n_tokens"]) for r in out)
    big = "z " * 15_000 + "middle" + "z " * 4_995
    assert got == sorted([(1, "omega BETA and gamma", encode("omega BETA and gamma"))] * 2
                         + [(2, "new text", 2), (3, "", 0), (-1, "x y", 2), (4, big[:40], encode(big))])
    assert all(r["n_encoded"] < 5000 or len(r["text"]) < 5000 or r["doc_id"] == 4 for r in out)
    assert tokencounts.build_trees(docs.limit(0), RANK_FILE).count() == 0


def test_only_near_copies_of_a_label_leave_the_sample():
    rng = random.Random(11)
    word = lambda: "%08x" % rng.getrandbits(32)
    texts, labels, copies = [], [], set()
    for _ in range(60):
        base = [word() for _ in range(60)]
        half = base[:40] + [word() for _ in range(20)]          # half of all tokens in common
        toxic = base + [word() for _ in range(6)]
        copy = base[:59] + [word()]
        for words, label in ((base, 0), (half, 0), (toxic, 1), (copy, 0)):
            texts.append(" ".join(words))
            labels.append(label)
        copies.add(len(texts) - 1)
    texts += [texts[2], "", None]
    labels += [1, 0, 0]
    fresh = toxicity.distinct_texts(texts, np.array(labels, dtype=float))
    gone = set(np.flatnonzero(~fresh).tolist())
    assert gone == copies | {240, 241, 242}

"""Collocations against a plain count of every phrase."""

import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import collocations
from ledgerlens.llm.collocations import Mining
from ledgerlens.llm.queries import ORACLES, QUERIES

import brute


def plain(rows, least=30, longest=4, limit=2000, scale=2_000_000, absorbed=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(brute.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, words[i:i + k])
                if 100 * a >= absorbed * f[inner]:
                    gone.add(inner)
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in gone:
            score, k = min((scale * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in found.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(some)[:limit]))


def run(spark, rows, m):
    docs = spark.createDataFrame([(lang, text, 1, "x", 2) for lang, text in rows],
                                 "lang string, text string, n int, phrase string, score int").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, m).collect())


def texts(n, seed, words=25, length=40):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, words + 1)
    some = []
    for i in range(n):
        out = []
        while len(out) < length:
            if rng.random() < 0.3:      # fixed expressions of several words, some inside others
                out += [["new", "york"], ["new", "york", "city", "hall"], ["of", "the", "day"], ["É", "t9"]][rng.integers(0, 4)]
            out.append(f"w{rng.choice(words, p=weight / weight.sum())}")
        gap = [" ", "  ", "\t", ", ", "\n"]
        some.append(("en" if i % 3 else "de", "".join(w + gap[rng.choice(5, p=[.8, .05, .05, .05, .05])] for w in out)))
    return some


@pytest.mark.parametrize("limit,batch", [(2000, 200_000), (3, 200_000), (12, 40)])
def test_against_plain_counts(spark, limit, batch):
    rows = texts(60, 5)
    assert run(spark, rows, Mining(least=4, limit=limit, round_prefixes=batch, part_bytes=900)) == plain(rows, least=4, limit=limit)


def test_ties_overlaps_nulls_and_a_full_bit_table(spark):
    rows = [(None, "a a a a a"), ("en", None), ("en", ""), (None, "x y. x y! X Y"), ("und", "x y"), ("de", "  \t "), ("de", ".,;"),
            ("fr", "b c d " * 5 + "e"), ("fr", "b c d " * 5 + "e"), ("fr", "日本 語　x " * 4), ("fr", "long" * 5000 + " tail\n" + "long" * 5000 + " tail")]
    rows += [("es", f"p{i} q{i} ") for i in range(6)] * 3
    for m in (Mining(least=2), Mining(least=2, limit=2, filter_bits=3), Mining(least=2, limit=4, salts=1)):
        assert run(spark, rows, m) == plain(rows, least=2, limit=m.limit)
    assert run(spark, [], Mining()) == []
    assert run(spark, [("en", "one two three")], Mining()) == []


def test_large_counts_stay_exact(spark):
    big = 1 << 62
    counts = spark.createDataFrame([("en", 1, "a", 1, big), ("en", 1, "b", 2, big + 3), ("en", 2, "a b", 3, big - 1)], collocations.COUNTS)
    pair = collocations.scored(counts, counts.filter("n = 2"), Mining())
    assert pair.first()["score"] == 2_000_000 * (big - 1) // (2 * big + 3)
    assert collocations.bounds(counts, pair, Mining()).first()["bound"] == 2_000_000 * (big - 1) // (2 * big - 1)


def test_query_against_sql(spark, duck):
    want = duck.execute(ORACLES["op12_collocations"])
    names = [d[0] for d in want.description]
    got = QUERIES["op12_collocations"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


class Held:
    """A broadcast value without a session."""

    def __init__(self, value):
        self.value = value


def test_extensions_with_a_rare_pair_are_not_sent():
    import pyarrow as pa
    m = Mining(least=3, filter_bits=16)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a b c d"] * 3 + ["a b x. z a b"])], names=["lang", "text"])
    p = collocations.Phrases(batch)
    pairs, ok = p.keys(2)
    key, f = np.unique(pairs[ok], return_counts=True)
    table = np.zeros(1 << 10, dtype=np.uint64)
    for bit in (key[f >= 3] >> np.uint64(48)).tolist():
        table[bit >> 6] |= np.uint64(1 << (bit & 63))
    wanted = {(n, side): np.sort(np.unique(p.keys(n)[0])) for n in (2, 3) for side in ("right", "left")}
    sent = pa.Table.from_batches(collocations.extension_counts(m, Held(wanted), Held(table))([batch])).to_pylist()
    assert sorted((r["phrase"], r["f"]) for r in sent) == [("a b c", 3), ("a b c d", 3), ("b c d", 3)]

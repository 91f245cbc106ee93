"""The pipeline against the plain versions of its stages, and the mix against its contract."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import mixing
from ledgerlens.llm.queries import ORACLES

import brute


def toxic_rows():
    rng = random.Random(7)
    rows = []
    for d in range(2000, 2400):
        w = ["%x" % rng.randint(0, 5000) + rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(20, 60))]
        toxic = int(d % 4 == 0)
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["grimblat", "grimblor", "vornak"]))
        rows.append((d, " ".join(w), "en", "t", None, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = brute.hard_docs() + [r[:5] for r in toxic_rows()]
    leak = brute.sentence(40, 31)
    rows += [(3000 + i, " ".join(brute.sentence(80, 300 + i) + leak[:40 - i] + brute.sentence(80, 400 + i)), "en", "b", 1) for i in range(12)]
    bench = [(1, " ".join(leak)), (2, None), (3, " ".join(brute.sentence(30, 999)))]
    spark.createDataFrame(rows, brute.SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], 1, r[5]) for r in toxic_rows()] + [(r[0], 1, 0) for r in brute.hard_docs()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, bench


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_pipeline_brute(spark, tables):
    folder, rows, bench = tables
    got = corpus_pipeline.run(spark, folder)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    toxic = {r[0] for r in toxic_rows() if r[5]}
    clean = [(r[0], r[1]) for r in rows if r[0] not in toxic]
    kept_lines = brute.line_dedup(clean)
    lines = [(d, kept_lines[d][2] if kept_lines[d][1] else t) for d, t in clean]
    groups = brute.simhash(lines)
    single = [(d, t) for d, t in lines if groups[d][1] == d]
    leaks = {d for d, _ in brute.contaminated(single, bench)}
    want = {d: t for d, t in single if d not in leaks}
    assert text == want and leaks and len(single) < len(lines)
    n_chars = {r["doc_id"]: r["n_chars"] for r in got.collect()}
    assert all(n_chars[d] == len(want[d]) for d in want if kept_lines[d][1])
    # the mix of what is left, in SQL
    con = duckdb.connect()
    documents = got.select("doc_id", "text", "source").toPandas()
    con.register("documents", documents)
    sql = con.execute(ORACLES["op8_source_mix"]).fetch_df().set_index("doc_id")
    for r in got.collect():
        assert (r["size"], r["taken"], r["target"]) == pytest.approx(tuple(sql.loc[r["doc_id"], ["size", "taken", "target"]]))


def test_stage_columns(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("x")).withColumn("items", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_mix_contract(spark):
    rows = brute.hard_docs()
    rows += rows[:3] + [(None, "a b c", "en", None, 1), (None, "a b c", "en", None, 1), (7, "x", "en", "\U0001F600", 1), (8, "y z", "en", "�", 1)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], brute.SCHEMA + ", size string")
    out = mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "position", "text").collect()
    assert len(out) == len(rows)
    total, by_source = 0, {}
    for r in out:
        assert r["size"] == len(brute.words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        s = by_source.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        total += r["size"]
    order = sorted((s for s in by_source if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, dict(weight), 1.5 * total
    while True:                                   # share by weight, stop the full ones, share the rest again
        level = {s: left * w / sum(free.values()) for s, w in free.items()}
        full = [s for s in free if level[s] > 2 * by_source[s][0]]
        if not full:
            target.update(level)
            break
        for s in full:
            target[s] = 2.0 * by_source[s][0]
            left -= target[s]
            del free[s]
    for s, (size, taken, t, source_size) in by_source.items():
        assert size == source_size and t == pytest.approx(target[s]) and abs(taken - t) <= 0.5
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "position", "text").collect()))


def test_mix_follows_the_schedule(spark):
    """The share of a source's words placed before t follows the integral of its weight, also in its second round."""
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs).toPandas()
    copies = mixing.training_order(mixing.mix_sources(docs)).toPandas()
    assert copies["position"].is_monotonic_increasing
    assert copies.groupby("doc_id")["words"].sum().to_dict() == out.loc[out["taken"] > 0].set_index("doc_id")["taken"].to_dict()
    assert out["positions"].str.len().max() == 2
    for slope, (_, part) in zip((-0.5, 0.0, 0.5), copies.groupby("source")):
        target = part["target"].iloc[0]
        for t in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0):
            until = part.loc[part["position"] < t, "words"].sum()
            assert abs(until - target * ((1 - slope) * t + slope * t * t)) <= 20
    assert out.loc[out["taken"] > 0, "position"].is_monotonic_increasing

"""Training pipeline smoke test with tiny model sizes on the smallest tables."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import features as FE
from ledgerlens.operators import ml as ML
from ledgerlens.operators import scoring as S
from ledgerlens.session import checkpoint_dir
from ledgerlens.sources.statements import planted_fraud
from ledgerlens.sources.tables import txn

SF = "/root/testdata/sf0.001"


def test_train_score_save_load(spark):
    cfg = ML.MLConfig(rf_trees=5, rf_depth=4, gbt_iters=5, gbt_depth=3, iso_trees=10)
    d = FE.engineer_features(txn(spark, SF)).withColumn(ML.LABEL, planted_fraud())
    models, metrics = ML.train(d, cfg)
    m = {r.model: r for r in metrics.collect()}
    assert set(m) == {"random_forest", "gbt_calibrated", "isolation_forest"}
    for r in m.values():
        assert 0.0 <= r.roc_auc <= 1.0 and r.tp + r.fp + r.fn + r.tn > 0
    path = f"{checkpoint_dir(spark)}/test-models"
    models.save(path)
    back = ML.FraudModels.load(spark, path, cfg)
    s = S.score_transactions(txn(spark, SF), Config(), models=back)
    stats = s.agg(F.min("iso_score"), F.max("iso_score"), F.min("ml_score"), F.max("ml_score")).collect()[0]
    assert 0.0 <= stats[0] <= stats[1] <= 100.0 and 0.0 <= stats[2] <= stats[3] <= 100.0
    assert s.select("dominant_signal").distinct().count() >= 1
    # the scored frame and the forest on its own agree row by row, batch or no batch
    alone = back.iso.score(back.iso.raw(d)).select("account_id", "seq", F.col("iso_score").alias("alone"))
    both = s.select("account_id", "seq", "iso_score").join(alone, ["account_id", "seq"])
    assert both.count() == d.count() and both.where(F.abs(F.col("iso_score") - F.col("alone")) > 1e-9).count() == 0
    few = d.where(F.col("seq") % 50 == 0)
    part = back.iso.score(back.iso.raw(few)).select("account_id", "seq", F.col("iso_score").alias("few")).join(
        alone, ["account_id", "seq"])
    assert part.where(F.col("few") != F.col("alone")).count() == 0


def test_isolation_scores_match_the_node_table_in_sql(spark, duck, tmp_path):
    """Walk the written node table in SQL and recompute every raw score."""
    cfg = ML.MLConfig(iso_trees=12)
    d = FE.engineer_features(txn(spark, SF)).withColumn(ML.LABEL, planted_fraud())
    forest = ML.fit_isolation(d, cfg)
    forest.nodes.write.parquet(str(tmp_path / "nodes"))
    names = list(cfg.features)
    value = [F.lit(0.0) if c == ML.ANOMALY else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
    z = F.array(*[(v - m) / (sd if sd > 0 else 1.0) for v, m, sd in zip(value, forest.mean, forest.std)])
    forest.raw(d).select("seq", z.alias("z"), "iso_raw").write.parquet(str(tmp_path / "rows"))
    worst, rows = duck.execute(f"""
        WITH RECURSIVE n AS (SELECT * FROM read_parquet('{tmp_path}/nodes/*.parquet')),
        r AS (SELECT * FROM read_parquet('{tmp_path}/rows/*.parquet')),
        walk AS (
          SELECT r.seq, n.tree, n.node FROM r, n WHERE n.node = 0
          UNION ALL
          SELECT w.seq, w.tree, CASE WHEN r.z[n.feature + 1] < n.threshold THEN n."left" ELSE n."right" END
          FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node AND n.feature >= 0 JOIN r ON r.seq = w.seq
        ), leaf AS (
          SELECT w.seq, n.depth + CASE WHEN n.size <= 1 THEN 0 WHEN n.size = 2 THEN 1
            ELSE 2 * (ln(n.size - 1) + 0.5772156649) - 2 * (n.size - 1) / n.size END AS h
          FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node AND n.feature < 0
        ), s AS (
          SELECT seq, -pow(2, -avg(h) / (2 * (ln(255) + 0.5772156649) - 2 * 255.0 / 256)) AS raw, count(*) AS trees
          FROM leaf GROUP BY seq
        )
        SELECT max(abs(s.raw - r.iso_raw)), count(*) FILTER (WHERE s.trees = 12) FROM s JOIN r USING (seq)""").fetchone()
    assert worst < 1e-9 and rows == d.count()


def test_tree_samples_at_a_billion_rows(spark):
    """The hash bound keeps about twice a tree's sample at any row count, and trees are full."""
    cfg = ML.MLConfig(iso_trees=3)
    for n in (10 ** 5, 10 ** 9, 10 ** 13):
        share = (ML.sample_threshold(n, cfg) + (1 << 63)) / (1 << 64)
        assert abs(share * n - 2 * cfg.iso_sample) < 1e-3 * cfg.iso_sample
    rows = spark.range(20_000).select(F.col("id").alias("seq"), *[F.rand(i).alias(c) for i, c in enumerate(cfg.features)])
    sizes = ML.train_iforest(rows, cfg).where("node = 0").count(), ML.train_iforest(rows, cfg).where("feature < 0").groupBy(
        "tree").agg(F.sum("size").alias("n")).collect()
    assert sizes[0] == 3 and {r["n"] for r in sizes[1]} == {256.0}


def test_missing_model_store_raises(spark):
    with pytest.raises(Exception):
        ML.FraudModels.load(spark, f"{checkpoint_dir(spark)}/no-such-models")


def test_split_is_exact_per_class(spark):
    df = spark.range(5000).select(F.col("id").alias("seq"), (F.col("id") % 1000 < 3).cast("int").alias(ML.LABEL))
    train, test = ML.stratified_split(df)
    count = {r[0]: r[1] for r in test.groupBy(ML.LABEL).count().collect()}
    assert count == {0: round(4985 * 0.2), 1: 3}
    assert train.count() + test.count() == 5000 and train.join(test, "seq").count() == 0


def test_eval_binary_matches_manual(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0), (0.6, 1)]
    df = spark.createDataFrame(rows, "s double, is_fraud int")
    r = ML.eval_binary(df, "s").collect()[0]
    # manual AUC: positives {0.9, 0.8, 0.6}, negatives {0.8, 0.3, 0.1}
    pairs = [(p, n) for p, y in rows if y == 1 for n, z in rows if z == 0]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert abs(r.roc_auc - auc) < 1e-12
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 0, 2)


def test_confidence_from_the_node_table(spark, duck, tmp_path):
    """Each tree applied by Spark, and the node table walked in SQL, give the spread of the one-pass scorer."""
    from pyspark.ml.functions import vector_to_array
    cfg = ML.MLConfig(rf_trees=6, rf_depth=5)
    d = FE.engineer_features(txn(spark, SF)).withColumn(ML.LABEL, planted_fraud())
    train, _ = ML.prepare(d, cfg)
    rf = ML.train_rf(train, cfg)
    got = ML.score_confidence(d, rf).toPandas().set_index(["account_id", "seq"])["confidence_score"]
    assert len(got) == d.count() and got.between(0.5, 1).all() and got.nunique() > 3
    vectors = rf.stages[1].transform(rf.stages[0].transform(d)).cache()
    per_tree = [t.setFeaturesCol("features").setProbabilityCol("p").setPredictionCol("q").setRawPredictionCol("r").transform(vectors)
                .select("account_id", "seq", vector_to_array("p")[1].alias("p")).toPandas().set_index(["account_id", "seq"])["p"]
                for t in rf.stages[-1].trees]
    want = 1 - sum((p - sum(per_tree) / 6) ** 2 for p in per_tree).div(6) ** 0.5
    assert (got - want).abs().max() < 1e-9
    ML.forest_nodes(rf).write.parquet(str(tmp_path / "nodes"))
    vectors.select("account_id", "seq", vector_to_array("features").alias("x")).write.parquet(str(tmp_path / "rows"))
    sql = duck.execute(f"""
        WITH RECURSIVE n AS (SELECT * FROM read_parquet('{tmp_path}/nodes/*.parquet')),
        r AS (SELECT * FROM read_parquet('{tmp_path}/rows/*.parquet')),
        walk AS (
          SELECT account_id, seq, x, tree, 0 AS node FROM r, (SELECT DISTINCT tree FROM n)
          UNION ALL
          SELECT w.account_id, w.seq, w.x, w.tree, CASE WHEN w.x[n.feature + 1] <= n.threshold THEN n."left" ELSE n."right" END
          FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node AND n.feature >= 0)
        SELECT w.account_id, w.seq, 1 - stddev_pop(n.p) AS c FROM walk w JOIN n ON n.tree = w.tree AND n.node = w.node AND n.feature < 0
        GROUP BY ALL""").df().set_index(["account_id", "seq"])["c"]
    assert (got - sql).abs().max() < 1e-9
    scored = ML.FraudModels(rf=rf, cfg=cfg).transform(d).select("account_id", "seq", "confidence_score").toPandas()
    assert (scored.set_index(["account_id", "seq"])["confidence_score"] - got).abs().max() < 1e-9

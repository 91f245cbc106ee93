"""Model training, evaluation and scoring with Spark ML.

* split: per class the rows with the smallest hashes of (row, seed), counted
  exactly, without gathering a class in one task;
* imbalance: class weights = n / (2 n_class) from the training split only
  (no synthetic oversampling before the split);
* RF / GBT: the models of ``RandomForestClassifier`` / ``GBTClassifier`` in one Pipeline
  with the assembler and scaler, so training and scoring see the same
  features, grown as histogram trees (``trees.py``); the boosted model is fitted and calibrated in
  three folds: each booster learns from two of them, ``IsotonicRegression`` calibrates it on the
  third, and the three calibrated probabilities are averaged;
* isolation forest (not in spark.ml): each tree gets the 256 rows with the
  smallest hashes, features are scaled and the score's bounds frozen at fit time; each tree is grown by ``groupBy(tree).applyInPandas``; the node
  table has a proven bound (trees x (2 * 256 - 1) rows) and is broadcast to a
  vectorized ``pandas_udf`` scorer;
* evaluation: confusion counts and exact ROC-AUC / average precision from
  per-score positive/negative counts and bucketed prefix sums (no global sort
  into one task).
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import columns as C
from ledgerlens.functions.windows import bucketed_running_sum, range_parts
from ledgerlens.operators import trees
from ledgerlens.operators.features import FEATURE_COLS

LABEL = "is_fraud"
ANOMALY = "anomaly_score_raw"      # the feature that the isolation forest fills in


@dataclass(frozen=True)
class MLConfig:
    seed: int = 42
    test_fraction: float = 0.20
    calib_folds: int = 3
    # fixed values: model sizes of the reference trainer
    rf_trees: int = 200
    rf_depth: int = 12
    rf_min_leaf: int = 5
    gbt_iters: int = 300
    gbt_depth: int = 6
    gbt_step: float = 0.05
    gbt_subsample: float = 0.8
    iso_trees: int = 200
    iso_sample: int = 256
    iso_feature_share: float = 0.8
    type_trees: int = 200
    type_depth: int = 5
    features: tuple[str, ...] = tuple(FEATURE_COLS)


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = g.agg(F.sum("count").alias("total"))
    return g.crossJoin(tot).select(label, "count", (F.col("count") / F.col("total") * 100).alias("pct"))


def split_flag(seed: int, test_fraction: float, key: str = "seq") -> F.Column:
    """True for the rows whose hash of (key, seed) lies in the lowest ``test_fraction``."""
    return F.xxhash64(F.col(key), F.lit(seed)) < F.lit(_hash_below(test_fraction))


def _hash_below(share: float) -> int:
    """The signed 64-bit value below which a uniform hash falls with probability ``share``."""
    return -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))


def stratified_split(df: DataFrame, cfg: MLConfig = MLConfig(), key: str = "seq", label: str = LABEL):
    """(train, test): of every class exactly round(test_fraction x its rows) rows, at least one
    of two or more, go to the test part: those with the smallest hashes of (key, seed).

    Counts per (class, 4096 hash ranges) find the range in which a class's cut falls; only the
    rows of that one range are ranked."""
    h = F.xxhash64(F.col(key), F.lit(cfg.seed))
    d = df.withColumns({"__h": h, "__b": F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 52).cast("int")})
    per = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label).orderBy("__b")
    per = per.withColumns({"__upto": F.sum("__n").over(w),
                           "__all": F.sum("__n").over(Window.partitionBy(label))})
    want = F.greatest(F.round(F.col("__all") * cfg.test_fraction).cast("long"), (F.col("__all") > 1).cast("long"))
    cut = (per.where((F.col("__upto") >= want) & (F.col("__upto") - F.col("__n") < want))
           .select(F.col(label).alias("__label"), F.col("__b").alias("__cut"),
                   (want - (F.col("__upto") - F.col("__n"))).alias("__take")))
    d = d.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("__label")), "left")       # one row per class
    inside = F.col("__b") == F.col("__cut")
    nth = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    ranked = d.where(inside).withColumn("__test", nth <= F.col("__take"))
    rest = d.where(~F.coalesce(inside, F.lit(False))).withColumn("__test", F.coalesce(F.col("__b") < F.col("__cut"), F.lit(False)))
    d = rest.unionByName(ranked).drop("__h", "__b", "__label", "__cut", "__take")
    return d.where(~F.col("__test")).drop("__test"), d.where(F.col("__test")).drop("__test")


def with_class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """weight = n / (2 * n_class), computed on the training split."""
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = g.agg(F.sum("__nc").alias("__n"))
    w = g.crossJoin(tot).select(label, (F.col("__n") / (2.0 * F.col("__nc"))).alias("weight"))
    return train.join(F.broadcast(w), label)      # at most two rows: bounded


def _assembler(cfg: MLConfig):
    return [VectorAssembler(inputCols=list(cfg.features), outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def scaler(train: DataFrame, cfg: MLConfig = MLConfig()) -> PipelineModel:
    """Assembler and standard scaler as the models have them."""
    return Pipeline(stages=_assembler(cfg)).fit(train)


def _prob1(c: str) -> F.Column:
    return vector_to_array(F.col(c))[1]


@dataclass
class IsolationForest:
    """Node table plus everything that scoring needs, frozen at fit time: the scaling of the
    features, the bounds of the raw score and the cut-off of the contamination share."""
    nodes: DataFrame
    mean: list[float]
    std: list[float]
    bounds: tuple[float, float]
    cutoff: float
    contamination: float
    cfg: MLConfig = field(default_factory=MLConfig)

    def raw(self, d: DataFrame) -> DataFrame:
        """Adds ``iso_raw`` (higher: more normal) to rows with unscaled features; the anomaly
        feature itself is 0 in this first pass."""
        names = [f"__z{i}" for i in range(len(self.cfg.features))]
        z = {}
        for n, c, m, sd in zip(names, self.cfg.features, self.mean, self.std):
            v = F.lit(0.0) if c == ANOMALY else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            z[n] = (v - F.lit(m)) / F.lit(sd if sd > 0 else 1.0)
        return iso_raw(d.withColumns(z), self.nodes, self.cfg, names).drop(*names)

    def score(self, d: DataFrame) -> DataFrame:
        """Adds ``iso_score`` (0-100, higher: more anomalous) to rows with ``iso_raw``."""
        lo, hi = self.bounds
        norm = (1.0 - (F.col("iso_raw") - lo) / (hi - lo + 1e-9)) if hi != lo else F.lit(0.0)
        return d.withColumn("iso_score", C.clip(norm * 100.0, 0.0, 100.0))


@dataclass
class FraudModels:
    rf: PipelineModel | None = None
    gbt: list[PipelineModel] | None = None                       # one for each calibration fold
    calibrator: list[IsotonicRegressionModel] | None = None
    iso: IsolationForest | None = None
    fraud_type: PipelineModel | None = None
    type_names: dict[int, str] = field(default_factory=dict)
    cfg: MLConfig = field(default_factory=MLConfig)
    rf_nodes: DataFrame | None = None

    @property
    def iso_nodes(self) -> DataFrame | None:
        return self.iso.nodes if self.iso is not None else None

    def transform(self, d: DataFrame) -> DataFrame:
        """Adds xgb_prob, rf_prob, iso_score, confidence_score (and fraud_type_code).

        Two passes: the isolation forest scores the rows first, and its raw score is the
        anomaly feature that the supervised models see."""
        if self.iso is not None:
            d = self.iso.score(self.iso.raw(d)).withColumn(ANOMALY, F.col("iso_raw")).drop("iso_raw")
        else:
            d = d.withColumn("iso_score", F.lit(0.0))
        cols = d.columns
        if self.gbt is not None:
            folds = [f"__p{k}" for k in range(len(self.gbt))]
            for k, (name, model) in enumerate(zip(folds, self.gbt)):
                g = model.transform(d).withColumn("__g", _prob1("gbt_probability"))
                if self.calibrator is not None:
                    g = self.calibrator[k].transform(g).withColumn("__g", F.col("__gc"))
                d = g.select(*cols, *folds[:k], F.col("__g").alias(name))
            total = sum((F.col(p) for p in folds[1:]), F.col(folds[0]))
            d = d.select(*cols, (total / len(folds)).alias("xgb_prob"))
        else:
            from ledgerlens.operators.scoring import fallback_prob
            d = d.withColumn("xgb_prob", fallback_prob())
        cols = d.columns
        if self.rf is not None:
            if self.rf_nodes is None:
                self.rf_nodes = forest_nodes(self.rf)
            votes = forest_votes(vector_to_array("features"), self.rf_nodes)
            d = (self.rf.stages[1].transform(self.rf.stages[0].transform(d)).withColumn("__v", votes)
                 .select(*[c for c in cols if c != "confidence_score"], F.col("__v.p").alias("rf_prob"),
                         (1.0 - F.col("__v.spread")).alias("confidence_score")))
        else:
            d = d.withColumn("rf_prob", F.col("xgb_prob")).withColumn("confidence_score", F.lit(1.0))
        if self.fraud_type is not None:
            cols = d.columns
            d = self.fraud_type.transform(d).select(*cols, F.col("ft_pred").cast("int").alias("fraud_type_code"))
        return d

    def predicted_type(self, score: F.Column, threshold: float) -> F.Column | None:
        """Name of the learned fraud type from ``threshold`` on, else 'Normal'; None without a model."""
        if self.fraud_type is None:
            return None
        names = F.create_map(*[F.lit(x) for kv in sorted(self.type_names.items()) for x in kv])
        return F.when(score < threshold, "Normal").otherwise(
            F.coalesce(F.try_element_at(names, F.col("fraud_type_code")), F.lit("Unknown Fraud")))

    def save(self, path: str) -> None:
        """Every part below ``path``, and last a manifest that names them."""
        spark = SparkSession.active()
        parts = {"random_forest": self.rf, "gbt": self.gbt, "calibrator": self.calibrator, "fraud_type": self.fraud_type}
        for name, model in parts.items():
            if isinstance(model, list):
                for k, m in enumerate(model):
                    m.write().overwrite().save(f"{path}/{name}/fold={k}")
            elif model is not None:
                model.write().overwrite().save(f"{path}/{name}")
        if self.iso is not None:
            self.iso.nodes.write.mode("overwrite").parquet(f"{path}/isolation_forest")
        if self.rf is not None:
            feature_importance(spark, self.rf, self.cfg).write.mode("overwrite").parquet(f"{path}/feature_importance")
        iso = self.iso
        manifest = {"parts": sorted([n for n, m in parts.items() if m is not None] + ["isolation_forest"] * (iso is not None)),
                    "folds": len(self.gbt or []), "type_names": {str(k): v for k, v in self.type_names.items()},
                    "iso": None if iso is None else {"mean": iso.mean, "std": iso.std, "bounds": list(iso.bounds),
                                                     "cutoff": iso.cutoff, "contamination": iso.contamination}}
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").write.mode("overwrite").parquet(f"{path}/manifest")

    @staticmethod
    def load(spark, path: str, cfg: MLConfig = MLConfig()) -> "FraudModels":
        """Load what the manifest names; a missing store or a part that cannot be read raises."""
        m = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
        have = set(m["parts"])
        pipe = lambda name: PipelineModel.load(f"{path}/{name}") if name in have else None
        folds = lambda name, kind: [kind.load(f"{path}/{name}/fold={k}") for k in range(m["folds"])] if name in have else None
        iso = m["iso"]
        return FraudModels(
            rf=pipe("random_forest"), gbt=folds("gbt", PipelineModel), fraud_type=pipe("fraud_type"),
            calibrator=folds("calibrator", IsotonicRegressionModel),
            iso=None if iso is None else IsolationForest(
                spark.read.schema(NODE_SCHEMA).parquet(f"{path}/isolation_forest"), iso["mean"], iso["std"],
                tuple(iso["bounds"]), iso["cutoff"], iso["contamination"], cfg),
            type_names={int(k): v for k, v in m["type_names"].items()}, cfg=cfg)


def train_rf(train: DataFrame, cfg: MLConfig = MLConfig(), held: int = 50_000_000) -> PipelineModel:
    """Spark's own grower keeps a bag count and a place of every row in every tree; beyond ``held`` such pairs
    (250,000 rows of 200 trees) the forest is grown over binned rows, which keep neither."""
    rf = RandomForestClassifier(labelCol=LABEL, featuresCol="features", weightCol="weight", numTrees=cfg.rf_trees,
                                maxDepth=cfg.rf_depth, minInstancesPerNode=cfg.rf_min_leaf, seed=cfg.seed,
                                cacheNodeIds=True,       # else every row walks every tree anew for each level
                                probabilityCol="rf_probability", rawPredictionCol="rf_raw", predictionCol="rf_pred")
    if train.count() * cfg.rf_trees <= held:
        return Pipeline(stages=[*_assembler(cfg), rf]).fit(train)
    prep = Pipeline(stages=_assembler(cfg)).fit(train)
    return PipelineModel([*prep.stages, trees.forest(rf, prep.transform(train), LABEL, _class_weights(train))])


def _class_weights(train: DataFrame) -> tuple[float, float]:
    """The weights of class 0 and 1, which all rows of a class share."""
    got = {int(r[0]): float(r[1]) for r in train.groupBy(LABEL).agg(F.min("weight")).collect()}
    return got.get(0, 1.0), got.get(1, 1.0)


def train_gbt(train: DataFrame, cfg: MLConfig = MLConfig()) -> tuple[list[PipelineModel], list[IsotonicRegressionModel]]:
    """A booster and its calibrator for each of ``calib_folds`` stratified folds: grown on the other folds,
    calibrated on this one."""
    gbt = GBTClassifier(labelCol=LABEL, featuresCol="features", weightCol="weight", maxIter=cfg.gbt_iters,
                        maxDepth=cfg.gbt_depth, stepSize=cfg.gbt_step, subsamplingRate=cfg.gbt_subsample,
                        featureSubsetStrategy=str(cfg.iso_feature_share), seed=cfg.seed,
                        predictionCol="gbt_pred")
    gbt.setProbabilityCol("gbt_probability").setRawPredictionCol("gbt_raw")
    prep = Pipeline(stages=_assembler(cfg)).fit(train)
    rows = trees.folded(train, LABEL, cfg.calib_folds, cfg.seed + 1)
    no, yes = _class_weights(train)
    grown = trees.boost(gbt, prep.transform(rows), LABEL, cfg.calib_folds, (1.0, yes / no))     # weight of class 1: neg / pos
    models = [PipelineModel([*prep.stages, m]) for m in grown]
    iso = IsotonicRegression(featuresCol="__g", labelCol=LABEL, predictionCol="__gc", isotonic=True)
    calibrators = []
    for k, model in enumerate(models):
        scored = model.transform(rows.where(F.col("__fold") == k)).withColumn("__g", _prob1("gbt_probability"))
        calibrators.append(iso.fit(scored.select("__g", F.col(LABEL).cast("double").alias(LABEL))))
    return models, calibrators


# ------------------------------------------------------------ isolation forest
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, features: list[str], share: float, seed: int, sample: int) -> pd.DataFrame:
    tree = int(pdf["__tree"].iloc[0])
    rng = np.random.default_rng(seed + tree)
    # the sample is the rows with the smallest hashes, whatever order they came in
    x = pdf.sort_values(["__h", "seq"]).head(sample)[features].to_numpy(dtype=float)
    k = max(1, int(round(share * len(features))))
    feats = rng.choice(len(features), size=k, replace=False)
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    rows = []

    def node(idx, depth):
        nid = len(rows)
        rows.append(None)
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            rows[nid] = (tree, nid, -1, 0.0, -1, -1, float(len(idx)), depth)
            return nid
        f = int(rng.choice(feats))
        lo, hi = sub[:, f].min(), sub[:, f].max()
        if lo == hi:
            rows[nid] = (tree, nid, -1, 0.0, -1, -1, float(len(idx)), depth)
            return nid
        thr = float(rng.uniform(lo, hi))
        left = node(idx[sub[:, f] < thr], depth + 1)
        right = node(idx[sub[:, f] >= thr], depth + 1)
        rows[nid] = (tree, nid, f, thr, left, right, float(len(idx)), depth)
        return nid
    node(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size double, depth int"


def sample_threshold(n: int, cfg: MLConfig = MLConfig()) -> int:
    """Signed 64-bit hash bound under which about twice a tree's sample of ``n`` rows falls."""
    return _hash_below(min(1.0, 2.0 * cfg.iso_sample / max(n, 1)))


def train_iforest(normal: DataFrame, cfg: MLConfig = MLConfig(), n: int | None = None) -> DataFrame:
    """Node table of an isolation forest grown on (scaled) normal rows.

    A tree's sample is the ``iso_sample`` rows with the smallest hashes of (row, tree); rows under
    a 64-bit hash bound, about twice as many whatever ``n``, are sent to the tree's task."""
    n = normal.count() if n is None else n
    if not n:
        raise ValueError("an isolation forest needs normal rows")
    bound = sample_threshold(n, cfg)
    feats = list(cfg.features)
    hashes = F.transform(F.sequence(F.lit(0), F.lit(cfg.iso_trees - 1)),
                         lambda t: F.struct(t.alias("t"), F.xxhash64(F.col("seq"), t, F.lit(cfg.seed)).alias("h")))
    trees = F.filter(hashes, lambda x: x["h"] <= F.lit(bound))
    d = (normal.select("seq", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
         .withColumn("__t", F.explode(trees)).withColumns({"__tree": F.col("__t.t"), "__h": F.col("__t.h")}).drop("__t"))
    share, seed, sample = cfg.iso_feature_share, cfg.seed, cfg.iso_sample
    return d.groupBy("__tree").applyInPandas(lambda pdf: _grow(pdf, feats, share, seed, sample), NODE_SCHEMA)


def fit_isolation(rows: DataFrame, cfg: MLConfig = MLConfig()) -> IsolationForest:
    """Fit on the normal rows of ``rows`` (unscaled features and label): scaling, nodes, the bounds of
    the raw score over all rows, and the cut-off of the contamination share of the normal rows."""
    from ledgerlens.session import cut_lineage
    feats = list(cfg.features)
    value = lambda c: F.lit(0.0) if c == ANOMALY else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(LABEL) == 1).cast("long")).alias("bad"),
                     *[F.avg(value(c)).alias(f"m_{c}") for c in feats],
                     *[F.stddev_pop(value(c)).alias(f"s_{c}") for c in feats]).first()
    if not stats["n"]:
        raise ValueError("an isolation forest needs rows")
    mean, std = [float(stats[f"m_{c}"]) for c in feats], [float(stats[f"s_{c}"]) for c in feats]
    scaled = rows.where(F.col(LABEL) == 0).select("seq", *[
        ((value(c) - F.lit(m)) / F.lit(sd if sd > 0 else 1.0)).alias(c) for c, m, sd in zip(feats, mean, std)])
    nodes = cut_lineage(train_iforest(scaled, cfg))
    grown = nodes.select("tree").distinct().count()
    if grown != cfg.iso_trees:
        raise ValueError(f"{cfg.iso_trees - grown} of {cfg.iso_trees} isolation trees are empty")
    contamination = min(0.1, max(0.001, (stats["bad"] or 0) / stats["n"]))
    forest = IsolationForest(nodes, mean, std, (0.0, 0.0), 0.0, contamination, cfg)
    raw = forest.raw(rows)
    lo, hi, cutoff = raw.agg(
        F.min("iso_raw"), F.max("iso_raw"),
        F.percentile_approx(F.when(F.col(LABEL) == 0, F.col("iso_raw")), contamination, 10_000)).first()
    forest.bounds, forest.cutoff = (float(lo), float(hi)), float(cutoff)
    return forest


def _walk(g: pd.DataFrame) -> tuple:
    """A tree's levels and, for every node, the split, the children (a leaf: itself) and the path length of a row
    that ends there."""
    leaf, own = g["feature"].to_numpy() < 0, np.arange(len(g))
    return (int(g["depth"].max()), np.maximum(g["feature"].to_numpy(), 0), g["threshold"].to_numpy(),
            np.where(leaf, own, g["left"].to_numpy()), np.where(leaf, own, g["right"].to_numpy()),
            g["depth"].to_numpy() + np.array([_c(s) for s in g["size"]]))


def iso_raw(d: DataFrame, nodes: DataFrame, cfg: MLConfig = MLConfig(), cols: list[str] | None = None) -> DataFrame:
    """Adds ``iso_raw`` = -2^(-E[h(x)] / c(sample)) (higher = more normal, like
    score_samples) of the scaled columns ``cols``.  The node table is collected once: its size is bounded by
    trees x (2 * sample - 1) rows."""
    pn = nodes.toPandas().sort_values(["tree", "node"])
    feats = list(cols or cfg.features)
    trees = [g.reset_index(drop=True) for _, g in pn.groupby("tree")]
    arrays = [_walk(g) for g in trees]
    bc = d.sparkSession.sparkContext.broadcast(arrays)
    cn = _c(cfg.iso_sample)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.fillna(0.0).to_numpy(dtype=float) for c in cols])
        line, total = np.arange(len(x)), np.zeros(len(x))
        for levels, feat, thr, left, right, path in bc.value:
            cur = np.zeros(len(x), dtype=int)
            for _ in range(levels):
                cur = np.where(x[line, feat[cur]] < thr[cur], left[cur], right[cur])
            total += path[cur]
        mean = total / max(len(bc.value), 1)
        return pd.Series(-np.power(2.0, -mean / cn))
    return d.withColumn("iso_raw", score(*[F.col(c).cast("double") for c in feats]))


# ------------------------------------------------------------------ evaluation
def eval_binary(pred: DataFrame, score: str, label: str = LABEL, threshold: float = 0.5,
                flag: F.Column | None = None) -> DataFrame:
    """One row: TP/FP/FN/TN at ``score > threshold`` (or where ``flag`` holds), precision, recall, F1
    (zero-safe), exact ROC-AUC (ties count half) and average precision."""
    hit = F.col(score).cast("double") > threshold if flag is None else flag
    s = pred.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), hit.alias("hit"))
    conf = s.agg(
        F.count(F.when(F.col("hit") & (F.col("y") == 1), 1)).alias("tp"),
        F.count(F.when(F.col("hit") & (F.col("y") == 0), 1)).alias("fp"),
        F.count(F.when(~F.col("hit") & (F.col("y") == 1), 1)).alias("fn"),
        F.count(F.when(~F.col("hit") & (F.col("y") == 0), 1)).alias("tn"))
    per = s.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    per = range_parts(per, "s", "__b").withColumns({"__k": F.lit(0), "__neg_s": -F.col("s")})
    # ascending prefix of negatives (for AUC), descending prefix of positives/all (for AP)
    asc = bucketed_running_sum(per, ["__k"], "s", "s", "n", "n_le", bucket_col="__b")
    desc = bucketed_running_sum(asc.withColumn("__b", -F.col("__b")), ["__k"], "__neg_s", "__neg_s", "p", "tp_ge",
                                bucket_col="__b")
    desc = bucketed_running_sum(desc, ["__k"], "__neg_s", "__neg_s", F.col("p") + F.col("n"), "all_ge", bucket_col="__b")
    tot = per.agg(F.sum("p").alias("__pos"), F.sum("n").alias("__neg"))
    j = desc.crossJoin(tot)
    agg = j.agg(
        (F.sum(F.col("p") * (F.col("n_le") - F.col("n") + 0.5 * F.col("n"))) / (F.first("__pos") * F.first("__neg"))).alias("roc_auc"),
        F.sum(F.when(F.col("p") > 0, F.col("p") / F.col("__pos") * F.col("tp_ge") / F.col("all_ge")).otherwise(0.0)).alias("avg_precision"))
    out = conf.crossJoin(agg)
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = out.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def feature_importance(spark, rf: PipelineModel, cfg: MLConfig = MLConfig()) -> DataFrame:
    """RF importances by feature name (one row per feature: bounded)."""
    imp = rf.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(cfg.features, imp)], "feature string, importance double")


def prepare(df: DataFrame, cfg: MLConfig = MLConfig(), rows_per_part: int = 200_000,
            least_per_part: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The weighted training part and the test part, each stored once: the features are derived a single time."""
    from ledgerlens.session import cut_lineage
    train_df, test_df = stratified_split(cut_lineage(df), cfg)
    train_df = cut_lineage(with_class_weights(train_df))
    parts = training_parts(train_df.count(), df.sparkSession.sparkContext.defaultParallelism, rows_per_part, least_per_part)
    train_df = train_df.coalesce(1) if parts == 1 else train_df.repartition(parts, "seq")
    return cut_lineage(train_df), cut_lineage(test_df)


def training_parts(rows: int, cores: int, rows_per_part: int = 200_000, least_per_part: int = 10_000) -> int:
    """Partitions of a training set: one for each core where that leaves ``least_per_part`` rows to each, and more where
    a partition would have more than ``rows_per_part``.  Each sends the counts of all open nodes at every level, so
    what a forest shuffles grows with their number; each is held as one block, with a count for every tree in a row."""
    return max(1, -(-rows // rows_per_part), min(cores, -(-rows // least_per_part)))


def dealt(rows: DataFrame, rows_per_part: int = 100_000, key: str = "seq") -> DataFrame:
    """``rows`` stored once and dealt out by ``key`` where they stand in fewer partitions than their number
    asks for: a forest holds a partition's bagged rows as one block and reads it again for every group of nodes."""
    from ledgerlens.session import cut_lineage
    rows = cut_lineage(rows)
    parts = -(-rows.count() // rows_per_part)
    return rows if parts <= rows.rdd.getNumPartitions() else rows.repartition(parts, key)


def evaluate(models: FraudModels, test: DataFrame) -> DataFrame:
    """Metrics on the test part: a row per model that ``models`` holds.  The rows are scored once and their
    scores stored, as each metric reads them several times."""
    from ledgerlens.session import cut_lineage
    pred = models.transform(test)
    scored = []
    if models.rf is not None:
        scored.append(("random_forest", "rf_prob", None))
    if models.gbt is not None:
        scored.append(("gbt_calibrated", "xgb_prob", None))
    if models.iso is not None:
        # 0-1 like the other scores; a row is an anomaly below the cut-off of the raw score
        lo, hi = models.iso.bounds
        pred = pred.withColumn("iso_prob", 1.0 - (F.col(ANOMALY) - lo) / (hi - lo + 1e-9))
        scored.append(("isolation_forest", "iso_prob", F.col(ANOMALY) < models.iso.cutoff))
    pred = cut_lineage(pred.select(LABEL, *[col for _, col, _ in scored], *([ANOMALY] if models.iso is not None else [])))
    metrics = None
    for name, col, flag in scored:
        m = eval_binary(pred, col, flag=flag).withColumn("model", F.lit(name))
        metrics = m if metrics is None else metrics.unionByName(m)
    return metrics


def train(df: DataFrame, cfg: MLConfig = MLConfig(), with_iforest: bool = True) -> tuple[FraudModels, DataFrame]:
    """Split, weight, fit RF + calibrated GBT (+ isolation forest on scaled
    normal rows) side by side, evaluate on the test split.  Returns the models and a
    metrics table (one row per model)."""
    from concurrent.futures import ThreadPoolExecutor
    train_df, test_df = prepare(df, cfg)
    with ThreadPoolExecutor(3) as pool:           # only submits Spark jobs
        gbt = pool.submit(train_gbt, train_df, cfg)
        rf = pool.submit(train_rf, train_df, cfg)
        iso = pool.submit(fit_isolation, train_df, cfg) if with_iforest else None
        models = FraudModels(rf=rf.result(), iso=iso.result() if iso else None, cfg=cfg)
        models.gbt, models.calibrator = gbt.result()
    return models, evaluate(models, test_df)


def train_fraud_type(train_df: DataFrame, names: dict[int, str], cfg: MLConfig = MLConfig(),
                     label: str = "fraud_type_label") -> tuple[PipelineModel, dict[int, str]]:
    """Multiclass forest of the fraud type on the model features."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="raw_features", numTrees=cfg.type_trees, maxDepth=cfg.type_depth,
                                seed=cfg.seed, predictionCol="ft_pred", probabilityCol="ft_prob", rawPredictionCol="ft_raw")
    return Pipeline(stages=[_assembler(cfg)[0], rf]).fit(train_df), dict(names)


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Metrics table with the best model flagged (max average precision;
    ties: model name)."""
    best = metrics.orderBy(F.desc("avg_precision"), "model").limit(1).select(F.col("model").alias("__best"))
    return metrics.crossJoin(best).withColumn("is_best", F.col("model") == F.col("__best")).drop("__best")


FOREST_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, p double"


def forest_nodes(rf: PipelineModel) -> DataFrame:
    """The forest as a table (tree, node, feature, threshold, left, right, p): a row goes left up to the
    threshold; a leaf (feature -1) gives the share of fraud ``p``.  At most trees x (2^(depth + 1) - 1) rows."""
    from ledgerlens.session import checkpoint_dir
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark)}/ledgerlens-forest-{uuid.uuid4().hex}"
    rf.stages[-1].write().save(path)
    n = F.col("nodeData")
    total = F.aggregate(n["impurityStats"], F.lit(0.0), lambda acc, x: acc + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.when(total > 0, F.get(n["impurityStats"], F.lit(1)) / total).otherwise(0.0).alias("p"))


def forest_votes(features: F.Column, nodes: DataFrame) -> F.Column:
    """(p, spread): mean and population std of the trees' P(fraud), in one pass over the rows.  A tree's nodes are
    a few short arrays that stay in the processor's cache while a batch of rows walks it; nothing is shuffled."""
    pn = nodes.toPandas().sort_values(["tree", "node"], kind="stable")
    trees = []
    for _, g in pn.groupby("tree"):                       # a tree's nodes are numbered from 0
        leaf, own = g["feature"].to_numpy() < 0, np.arange(len(g), dtype=np.int32)
        trees.append((np.maximum(g["feature"].to_numpy(), 0), g["threshold"].to_numpy(),
                      np.where(leaf, own, g["left"].to_numpy()).astype(np.int32),
                      np.where(leaf, own, g["right"].to_numpy()).astype(np.int32), leaf, g["p"].to_numpy()))
    shared = SparkSession.active().sparkContext.broadcast(trees)

    @F.pandas_udf("p double, spread double")
    def votes(rows: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"p": np.zeros(0), "spread": np.zeros(0)})
        x = np.ascontiguousarray(np.stack(rows.to_numpy()).astype(float).T)
        flat, n = x.ravel(), x.shape[1]
        line, mean, squares = np.arange(n), np.zeros(n), np.zeros(n)
        for k, (feature, threshold, left, right, leaf, p) in enumerate(shared.value):
            at, start = np.zeros(n, dtype=np.int32), feature.astype(np.int64) * n
            while not leaf[at].all():
                at = np.where(flat[start[at] + line] <= threshold[at], left[at], right[at])
            off = p[at] - mean
            mean += off / (k + 1)
            squares += off * (p[at] - mean)
        return pd.DataFrame({"p": mean, "spread": np.sqrt(squares / max(len(shared.value), 1))})
    return votes(features)


def score_confidence(d: DataFrame, rf: PipelineModel, key=("account_id", "seq")) -> DataFrame:
    """(key, confidence_score): how far the trees of the forest agree on each row."""
    vectors = rf.stages[1].transform(rf.stages[0].transform(d))
    return vectors.select(*key, (1.0 - forest_votes(vector_to_array("features"), forest_nodes(rf))["spread"]).alias("confidence_score"))

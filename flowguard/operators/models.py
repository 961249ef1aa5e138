"""Models (F7–F9, M1–M12) on MLlib, forests on ``forest``, boosted trees on ``boosting``, networks on ``neural``. Features
are assembled once into a vector column at the MLlib boundary; everything
around it stays columnar."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting, forest, neural
from .joins import small
from .sampling import cumulative_cut

SEED = 42
NETWORKS = {  # settings, and whether classes are weighted to balance
    "mlp": (neural.Settings(hidden=(128, 64, 32), batch=2_048, epochs=25, patience=5, seed=SEED), False),
    "deep_mlp": (neural.Settings(hidden=(256, 128, 64), batch=4_096, epochs=14, patience=3, dropout=0.25, normalise=True, single=True, seed=SEED), True),
}
HELD_OUT = 10  # one row in so many is held out to stop by where there are no validation rows
ROWS_PER_TASK = 20_000  # training rows to a partition: iterative fits run hundreds of jobs over them


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def label_indexer(label: str = "class1") -> StringIndexer:
    """Sorted label ↔ code (alphabetical, as a label encoder)."""
    return StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep")


def spec(name: str, n_features: int, n_classes: int):
    """Estimators with the reference's settings where MLlib has them."""
    common = dict(featuresCol="features", labelCol="label_idx", seed=SEED) if name != "naive_bayes" else {}
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=25, minInstancesPerNode=5, weightCol="weight", **common)
    if name == "logistic":
        return LogisticRegression(family="multinomial", maxIter=140, weightCol="weight", featuresCol="features", labelCol="label_idx")
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian", featuresCol="features", labelCol="label_idx", weightCol="weight")
    raise ValueError(name)


def balanced(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k · n_c), one row per label."""
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    return g.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias("weight"))


def with_weights(train: DataFrame, label: str) -> DataFrame:
    """The rows with their class's balanced weight."""
    return train.join(small(balanced(train, label)), label)


def fit(name: str, train: DataFrame, features: Sequence[str], label: str = "class1", val: DataFrame | None = None):
    """Returns (model, fit seconds, classes). ``val`` gives boosted trees a
    loss per round on rows that they don't learn from, and networks the rows
    that they stop by (without it a tenth of the training rows, by hash)."""
    if name == "random_forest":
        return _fit_forest(train, features, label)
    if name == "boosted_trees":
        return _fit_boosted(train, features, label, val)
    if name in NETWORKS:
        return _fit_network(name, train, features, label, val)
    x = assemble(with_weights(train, label), features)
    idx = label_indexer(label).fit(x)
    classes = list(idx.labels)
    est = spec(name, len(features), len(classes))
    # every iteration reads the assembled vectors: kept while fitting, in
    # partitions by their number, so small inputs don't pay for idle tasks
    rows = x.select(label, "weight", "features")
    rows = rows.coalesce(max(2, rows.count() // ROWS_PER_TASK)).persist()
    t = time.time()
    try:
        model = Pipeline(stages=[idx, est]).fit(rows)
    finally:
        rows.unpersist()
    return model, time.time() - t, classes


def _fit_forest(train: DataFrame, features: Sequence[str], label: str):
    """120 trees of depth 15, two rows to a leaf, 64 bins, the root of the features for a node, balanced weights."""
    t = time.time()
    weights = {r[label]: r["weight"] for r in balanced(train, label).collect() if r[label] is not None}
    classes = sorted(weights)
    model = forest.fit(train, features, label, classes, [weights[c] for c in classes], forest.Settings(seed=SEED))
    return model, time.time() - t, classes


def save(model, spark: SparkSession, path: str) -> None:
    if isinstance(model, forest.Forest):
        model.save(spark, path)
    else:
        model.write().save(path)


def params(model) -> str:
    """The settings a model was fitted with."""
    found = model.params() if isinstance(model, forest.Forest) else {p.name: v for p, v in model.stages[-1].extractParamMap().items()}
    return ", ".join(sorted(f"{n}={v}" for n, v in found.items()))


def _fit_boosted(train: DataFrame, features: Sequence[str], label: str, val: DataFrame | None):
    """140 rounds of depth 8 at rate 0.08, rows and columns drawn at 0.85, balanced weights, all classes under softmax."""
    t = time.time()
    cols = [*[F.col(f"`{c}`") for c in features], F.col(label)]
    rows = with_weights(train, label).select(*cols, "weight", F.lit("train").alias("split"))
    classes = sorted(r[0] for r in rows.select(label).distinct().collect() if r[0] is not None)
    if val is not None:
        rows = rows.unionByName(val.select(*cols, F.lit(1.0).alias("weight"), F.lit("val").alias("split")))
    model = boosting.fit(rows, features, label, classes, settings=boosting.Settings(seed=SEED))
    return model, time.time() - t, classes


def _fit_network(name: str, train: DataFrame, features: Sequence[str], label: str, val: DataFrame | None):
    t = time.time()
    settings, balanced = NETWORKS[name]
    cols = [*[F.col(f"`{c}`") for c in features], F.col(label)]
    rows = with_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    held = F.pmod(F.xxhash64(*cols), F.lit(HELD_OUT)) == 0 if val is None else F.lit(False)
    rows = rows.select(*cols, "weight", F.when(held, "val").otherwise("train").alias("split"))
    classes = sorted(r[0] for r in rows.select(label).distinct().collect() if r[0] is not None)
    if val is not None:
        rows = rows.unionByName(val.select(*cols, F.lit(1.0).alias("weight"), F.lit("val").alias("split")))
    model = neural.fit(rows, features, label, classes, settings=settings)
    return model, time.time() - t, classes


def score(model, df: DataFrame, features: Sequence[str], classes: Sequence[str], normal: str = "normal") -> DataFrame:
    """pred_code, pred_type (decoded) and attack score = 1 − P(normal)."""
    own = isinstance(model, boosting.BoostedTrees | forest.Forest | neural.Network)
    x = model.transform(df if own else assemble(df, features))
    conv = IndexToString(inputCol="prediction", outputCol="pred_type", labels=list(classes))
    x = conv.transform(x)
    if normal in classes:
        p = F.col("probability") if own else vector_to_array("probability")
        sc = F.lit(1.0) - p[list(classes).index(normal)]
    else:
        sc = F.lit(None).cast("double")
    return x.withColumn("pred_code", F.col("prediction").cast("int")).withColumn("score", sc)


def tree_importance(train: DataFrame, features: Sequence[str], label: str = "class1", trees: int = 50, top: int = 20) -> DataFrame:
    x = assemble(train, features)
    idx = label_indexer(label).fit(x)
    m = RandomForestClassifier(numTrees=trees, seed=SEED, featuresCol="features", labelCol="label_idx", maxDepth=12, maxMemoryInMB=1024).fit(idx.transform(x))
    imp = m.featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda r: (-r[1], r[0]))[:top]
    return train.sparkSession.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, rank int")


def pca_loadings(train: DataFrame, features: Sequence[str], share: float = 0.95) -> tuple[DataFrame, int]:
    """Fit PCA with k = p, keep the smallest k whose cumulative explained
    variance exceeds ``share``; long loadings (component, feature_index,
    feature, loading) for those k components (p·k numbers)."""
    x = assemble(train, features)
    p = len(features)
    m = PCA(k=p, inputCol="features", outputCol="pc").fit(x)
    ev = m.explainedVariance.toArray().tolist()
    k = cumulative_cut(ev, share)
    pcm = m.pc.toArray()  # p × p, column j = component j
    rows = [(j, i, features[i], float(pcm[i, j])) for j in range(k) for i in range(p)]
    df = train.sparkSession.createDataFrame(rows, "component int, feature_index int, feature string, loading double")
    return df, k

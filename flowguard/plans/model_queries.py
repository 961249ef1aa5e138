"""Registered queries: models (F7–F10, M1–M12). Fitting is not SQL: these get
the rows-only check, except the label index (M1)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import r6
from ..operators import boosting
from ..operators import evaluation as ev
from ..operators import features as feat
from ..operators import models as md
from ..operators import sampling
from ..session import scratch_path
from ..sources.fixtures import with_views
from . import prep_queries as pq
from .registry import query

_FITS: dict[tuple, tuple] = {}


def _data(spark: SparkSession, sf_dir: str):
    prep, fin = pq.final_features(spark, sf_dir)
    return prep, fin


def fitted(spark: SparkSession, sf_dir: str, name: str):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _FITS:
        prep, fin = _data(spark, sf_dir)
        train, val = (fin.filter(F.col("split") == x) for x in ("train", "val"))
        _FITS[key] = md.fit(name, train, prep.features, "class1", val)
    return _FITS[key]


def _metrics(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prep, fin = _data(spark, sf_dir)
    model, secs, classes = fitted(spark, sf_dir, name)
    scored = md.score(model, fin, prep.features, classes).select(
        "split", F.col("class1").alias("true_type"), F.col("class2").alias("true_cat"), F.col("class3").alias("true_bin"), "pred_type", "score")
    # labels and AUC each read the predictions: written, a model runs once over the rows
    path = scratch_path(spark, "scored")
    scored.write.option("compression", "zstd").parquet(path)
    sc = spark.read.schema(scored.schema).parquet(path).withColumn("model", F.lit(name))
    s = ev.level_scores(sc, ev.taxonomy(fin), ["model", "split"])
    return s.select("model", "split", r6("acc_type").alias("acc_type"), r6("f1_type").alias("f1_type"), r6("f1_cat").alias("f1_cat"),
                    r6("f1_bin").alias("f1_bin"), r6("f1_mean").alias("f1_mean"), r6("auc").alias("auc"), r6("fpr_bin").alias("fpr_bin"),
                    F.lit(round(secs, 3)).alias("fit_seconds"))


@query(
    "label_index",
    group="M",
    oracle=with_views("select class1 as label, (row_number() over (order by class1) - 1)::int as code from (select distinct class1 from flows) x", "flows"),
)
def q_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, fin = _data(spark, sf_dir)
    idx = md.label_indexer("class1").fit(fin.filter(F.col("split") == "train"))
    rows = [(lab, i) for i, lab in enumerate(idx.labels)]  # one row per class
    return spark.createDataFrame(rows, "label string, code int")


@query("tree_importance", group="F")
def q_tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, fin = _data(spark, sf_dir)
    train = fin.filter(F.col("split") == "train")
    sample = sampling.stratified_sample(train, "sample_id", "class3", 25_000, seed=42)
    return md.tree_importance(sample, prep.features, "class1", trees=50, top=20)


def _pca(spark: SparkSession, sf_dir: str):
    prep, fin = _data(spark, sf_dir)
    return md.pca_loadings(fin.filter(F.col("split") == "train"), prep.features, feat.PCA_VARIANCE)


@query("pca_components", group="F")
def q_pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    loadings, k = _pca(spark, sf_dir)
    return loadings.groupBy("component").agg(F.count(F.lit(1)).alias("n_loadings")).withColumn("k", F.lit(k))


@query("pcafss_rank", group="F")
def q_pcafss_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    loadings, _ = _pca(spark, sf_dir)
    return feat.pcafss_rank(loadings, feat.PCA_TOP)


@query("feature_inventory", group="F")
def q_feature_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    loadings, _ = _pca(spark, sf_dir)
    return feat.pcafss_rank(loadings, feat.PCA_TOP).select("feature", "rank")


@query("train_random_forest", group="M")
def q_train_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "random_forest")


@query("train_boosted_trees", group="M")
def q_train_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees (140 rounds, depth 8, step 0.08, row and column sampling
    0.85, balanced weights), all classes under softmax."""
    return _metrics(spark, sf_dir, "boosted_trees")


@query("train_decision_tree", group="M")
def q_train_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "decision_tree")


@query("train_logistic", group="M")
def q_train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "logistic")


@query("train_gaussian_nb", group="M")
def q_train_gaussian_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "naive_bayes")


@query("train_mlp", group="M")
def q_train_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 128-64-32 network under Adam: batches of 2,048, at most 25 epochs,
    stopped by the macro F1 of the validation rows."""
    return _metrics(spark, sf_dir, "mlp")


@query("train_deep_mlp", group="M")
def q_train_deep_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 256-128-64 network with normalisation by batch statistics, dropout
    0.25 and balanced weights: batches of 4,096, at most 14 epochs."""
    return _metrics(spark, sf_dir, "deep_mlp")


@query("score_batch", group="M")
def q_score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, fin = _data(spark, sf_dir)
    model, _, classes = fitted(spark, sf_dir, "random_forest")
    s = md.score(model, fin.filter(F.col("split") == "test"), prep.features, classes)
    return s.select("sample_id", "pred_code", "pred_type", r6("score").alias("attack_score"))


@query("predictions_table", group="M")
def q_predictions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, fin = _data(spark, sf_dir)
    model, _, classes = fitted(spark, sf_dir, "random_forest")
    s = md.score(model, fin, prep.features, classes).select("sample_id", "split", "pred_type", "score")
    d = ev.derive_hierarchy(s, ev.taxonomy(fin))
    return d.select("sample_id", "split", F.col("pred_type").alias("pred_class1"), F.col("pred_cat").alias("pred_class2"),
                    F.col("pred_bin").alias("pred_class3"), r6("score").alias("score_attack"))


@query("train_history", group="M")
def q_train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of the boosted trees after every round on every split, from one
    staged pass over all rows."""
    _, fin = _data(spark, sf_dir)
    model, _, _ = fitted(spark, sf_dir, "boosted_trees")
    losses = boosting.staged_losses(fin, model, "class1")
    return losses.select("round", "split", "rows", r6("log_loss").alias("log_loss"))


@query("network_history", group="M")
def q_network_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and macro F1 of both networks per epoch: of the training rows as
    the batches saw them, and of the validation rows after the epoch."""
    _data(spark, sf_dir)
    rows = []
    # a fit runs one task at a time: both are fitted at once
    with ThreadPoolExecutor(len(md.NETWORKS)) as pool:
        models = [pool.submit(inheritable_thread_target(spark)(fitted), spark, sf_dir, name) for name in md.NETWORKS]
    for name, found in zip(md.NETWORKS, models):
        model, _, _ = found.result()
        rows += [(name, epoch, split, round(loss, 6), round(f1, 6), epoch == model.best_epoch) for epoch, split, loss, f1 in model.history]
    return spark.createDataFrame(rows, "model string, epoch int, split string, loss double, f1 double, best boolean")


@query("model_loop", group="M")
def q_model_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates; fits made earlier in the application are used again."""
    _data(spark, sf_dir)
    names = ("random_forest", "boosted_trees", "decision_tree", "logistic", "naive_bayes", "mlp", "deep_mlp")
    # boosted trees wait for their many jobs and networks run one task at a time: the others are fitted meanwhile
    with ThreadPoolExecutor(2 + len(md.NETWORKS)) as pool:
        first = ("boosted_trees", *md.NETWORKS)
        fits = [pool.submit(inheritable_thread_target(spark)(fitted), spark, sf_dir, name) for name in (*first, *(n for n in names if n not in first))]
    for fit in fits:
        fit.result()
    out = None
    for name in names:
        m = _metrics(spark, sf_dir, name)
        out = m if out is None else out.unionByName(m)
    return out

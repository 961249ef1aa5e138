"""Evaluation (E1–E16) on any ``(group…, y_true, y_pred, score)`` table.

Every metric is an aggregate over the prediction rows: one pass builds
per-(group, label) counts, everything else is arithmetic over those small
tables. ROC/AUC need running sums over distinct scores; they use
``ordering.running_sums`` so a group with many distinct scores is not sorted
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import safe_div
from .joins import small
from .ordering import running_sums

# Review-cost assumptions (minutes per alert, cost per hour).
REVIEW_MINUTES = 3.0
HOURLY_COST = 25.0


def taxonomy(labels: DataFrame, type_col: str = "class1", cat_col: str = "class2", bin_col: str = "class3") -> DataFrame:
    """class1 → class2, class3 (functionally dependent); one row per type."""
    return labels.groupBy(type_col).agg(F.min(cat_col).alias(cat_col), F.min(bin_col).alias(bin_col))


def derive_hierarchy(preds: DataFrame, tax: DataFrame, pred_type: str = "pred_type") -> DataFrame:
    """Map predicted types to category and binary label (left join on type;
    the taxonomy has one row per label)."""
    t = tax.select(F.col("class1").alias("_t"), F.col("class2").alias("pred_cat"), F.col("class3").alias("pred_bin"))
    return preds.join(small(t), F.col(pred_type) == F.col("_t"), "left").drop("_t")


def class_inventory(labels: DataFrame, train: DataFrame) -> DataFrame:
    tax = taxonomy(labels)
    sup = train.groupBy("class1").agg(F.count(F.lit(1)).alias("_n"))
    return tax.join(sup, "class1", "left").select(
        "class1", "class2", "class3", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("support_train")
    )


def cells(df: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(group, labels…, weight): the number of rows of each combination of
    true and predicted labels. Every metric but AUC follows from this small
    table, so the rows themselves are aggregated once."""
    return df.groupBy(*by, *labels).agg(F.count(F.lit(1)).alias("weight"))


def binary_confusion(df: DataFrame, by: Sequence[str], y_true: str, y_pred: str, positive: str = "attack",
                     weight: str | None = None) -> DataFrame:
    t, p = F.col(y_true) == positive, F.col(y_pred) == positive
    w = F.col(weight) if weight else F.lit(1)

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0)).cast("long")

    return df.groupBy(*by).agg(total(~t & ~p).alias("tn"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"), total(t & p).alias("tp"),
                               F.sum(w).cast("long").alias("n"))


def accuracy(df: DataFrame, by: Sequence[str], pairs: dict[str, tuple[str, str]], weight: str | None = None) -> DataFrame:
    """``pairs``: output name → (true col, pred col)."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*by).agg(
        *[(F.sum(F.when(F.col(t) == F.col(p), w).otherwise(0)) / F.sum(w)).alias(name) for name, (t, p) in pairs.items()]
    )


def label_counts(df: DataFrame, by: Sequence[str], y_true: str, y_pred: str, weight: str | None = None) -> DataFrame:
    """(group, label, n_true, n_pred, tp) for every label seen as true or
    predicted in the group; one pass, each row emitted as two label rows."""
    one, zero = (F.col(weight) if weight else F.lit(1)).cast("long"), F.lit(0).cast("long")
    rows = F.explode(
        F.array(
            F.struct(F.col(y_true).alias("label"), one.alias("is_true"), zero.alias("is_pred"),
                     F.when(F.col(y_true) == F.col(y_pred), one).otherwise(zero).alias("is_tp")),
            F.struct(F.col(y_pred).alias("label"), zero.alias("is_true"), one.alias("is_pred"), zero.alias("is_tp")),
        )
    )
    x = df.select(*by, rows.alias("r")).select(*by, "r.*")
    return x.groupBy(*by, "label").agg(
        F.sum("is_true").cast("long").alias("n_true"), F.sum("is_pred").cast("long").alias("n_pred"), F.sum("is_tp").cast("long").alias("tp")
    )


def per_class_report(df: DataFrame, by: Sequence[str], y_true: str, y_pred: str, weight: str | None = None) -> DataFrame:
    c = label_counts(df, by, y_true, y_pred, weight)
    prec = F.coalesce(safe_div(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(safe_div(F.col("tp"), F.col("n_true")), F.lit(0.0))
    c = c.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.select(*by, "label", "precision", "recall", f1.alias("f1"), F.col("n_true").alias("support"))


def macro_weighted(report: DataFrame, by: Sequence[str]) -> DataFrame:
    w = F.col("support").cast("double")
    return report.groupBy(*by).agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        safe_div(F.sum(F.col("precision") * w), F.sum(w)).alias("precision_weighted"),
        safe_div(F.sum(F.col("recall") * w), F.sum(w)).alias("recall_weighted"),
        safe_div(F.sum(F.col("f1") * w), F.sum(w)).alias("f1_weighted"),
    )


def binary_prf(conf: DataFrame, by: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p = F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(safe_div(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * p * r, p + r), F.lit(0.0))
    return conf.select(*by, p.alias("precision_bin"), r.alias("recall_bin"), f1.alias("f1_bin"),
                       safe_div(fp, fp + tn).alias("fpr_bin"))


def score_counts(df: DataFrame, by: Sequence[str], y_true: str, score: str, positive: str = "attack") -> DataFrame:
    """(group, score, pos, neg): one row per distinct score."""
    pos = (F.col(y_true) == positive).cast("long")
    return df.groupBy(*by, score).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def auc_exact(df: DataFrame, by: Sequence[str], y_true: str, score: str, positive: str = "attack") -> DataFrame:
    """Mann–Whitney AUC with ties counted half; NULL when a class is absent."""
    sc = score_counts(df, by, y_true, score, positive)
    run = running_sums(sc, ["neg"], order_by=[score], partition_by=list(by), out_prefix="cum_")
    below = F.col("cum_neg") - F.col("neg")
    g = run.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    return g.select(*by, safe_div(F.col("_u"), F.col("_p") * F.col("_n")).alias("auc"))


def roc_points(df: DataFrame, by: Sequence[str], y_true: str, score: str, positive: str = "attack") -> DataFrame:
    """(group, threshold, fpr, tpr) at every distinct score, thresholds
    descending (score ≥ threshold is predicted positive)."""
    sc = score_counts(df, by, y_true, score, positive).withColumn("_neg_score", -F.col(score))
    run = running_sums(sc, ["pos", "neg"], order_by=["_neg_score"], partition_by=list(by), out_prefix="cum_")
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    keys = list(by) or ["_k"]
    if not by:  # one group: attach its totals by a constant key (equi-join)
        run, tot = run.withColumn("_k", F.lit(1)), tot.withColumn("_k", F.lit(1))
    x = run.join(small(tot), keys)
    return x.select(*by, F.col(score).alias("threshold"), safe_div(F.col("cum_neg"), F.col("_N")).alias("fpr"),
                    safe_div(F.col("cum_pos"), F.col("_P")).alias("tpr"))


def cost_metrics(conf: DataFrame, by: Sequence[str], minutes: float = REVIEW_MINUTES, rate: float = HOURLY_COST) -> DataFrame:
    alerts = F.col("tp") + F.col("fp")
    hours = alerts * F.lit(minutes / 60.0)
    return conf.select(
        *by,
        alerts.cast("long").alias("manual_alerts"),
        (alerts / F.col("n") * 1000).alias("manual_alerts_per_1000"),
        hours.alias("review_hours"),
        (hours / F.col("n") * 1000).alias("review_hours_per_1000"),
        (F.col("fp") * F.lit(minutes / 60.0 * rate)).alias("fp_cost_eur"),
        (alerts * F.lit(minutes / 60.0 * rate)).alias("total_operational_cost_eur"),
        F.col("fn").alias("missed_attacks"),
    )


def level_scores(preds: DataFrame, tax: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group: accuracy, macro P/R/F1 at type and category level,
    binary P/R/F1, FPR, AUC, confusion cells, f1_mean. The predictions are
    read twice: for the label cells (one exchange, reused by every metric)
    and for the scores of AUC."""
    rows = derive_hierarchy(preds, tax)
    d = cells(rows, by, ["true_type", "pred_type", "true_cat", "pred_cat", "true_bin", "pred_bin"])
    w = "weight"
    acc = accuracy(d, by, {"acc_type": ("true_type", "pred_type"), "acc_cat": ("true_cat", "pred_cat"), "acc_bin": ("true_bin", "pred_bin")}, w)
    mt = macro_weighted(per_class_report(d, by, "true_type", "pred_type", w), by).select(
        *by, F.col("precision_macro").alias("prec_type"), F.col("recall_macro").alias("rec_type"), F.col("f1_macro").alias("f1_type"))
    mc = macro_weighted(per_class_report(d, by, "true_cat", "pred_cat", w), by).select(
        *by, F.col("precision_macro").alias("prec_cat"), F.col("recall_macro").alias("rec_cat"), F.col("f1_macro").alias("f1_cat"))
    conf = binary_confusion(d, by, "true_bin", "pred_bin", weight=w)
    bp = binary_prf(conf, by)
    auc = auc_exact(rows, by, "true_bin", "score")
    out = acc.join(mt, list(by)).join(mc, list(by)).join(bp, list(by)).join(auc, list(by)).join(conf, list(by))
    return out.withColumn("f1_mean", (F.col("f1_bin") + F.col("f1_cat") + F.col("f1_type")) / 3.0)


def generalisation_gap(scores: DataFrame, model: str = "model", metric: str = "f1_mean") -> DataFrame:
    p = scores.groupBy(model).pivot("split", ["train", "val", "test"]).agg(F.first(metric))
    return p.select(model, (F.col("train") - F.col("val")).alias("gap_train_val"), (F.col("train") - F.col("test")).alias("gap_train_test"))


def model_ranking(scores: DataFrame, model: str = "model") -> DataFrame:
    """Per split: rank by f1_mean, f1_type, auc (desc), model name last."""
    w = Window.partitionBy("split").orderBy(F.col("f1_mean").desc(), F.col("f1_type").desc(), F.col("auc").desc_nulls_last(), F.col(model))
    return scores.select("split", model, "f1_mean", "f1_type", "auc", F.row_number().over(w).alias("rank"))


def melt(scores: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return scores.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(ids), list(metrics), "metric", "value")


def confusion_normalised(df: DataFrame, by: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    """All (true, pred) label cells per group, share of the true row; the
    grid comes from the group's label set (k² cells), not from a join."""
    cells = df.groupBy(*by, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    labels = df.groupBy(*by).agg(F.array_sort(F.array_union(F.collect_set(y_true), F.collect_set(y_pred))).alias("labels"))
    grid = labels.select(*by, F.explode("labels").alias("true_label"), "labels").select(*by, "true_label", F.explode("labels").alias("pred_label"))
    c = cells.select(*by, F.col(y_true).alias("true_label"), F.col(y_pred).alias("pred_label"), "n")
    g = grid.join(c, [*by, "true_label", "pred_label"], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    row_total = F.sum("n").over(Window.partitionBy(*by, "true_label"))
    return g.select(*by, "true_label", "pred_label", F.col("n").cast("long").alias("n"),
                    F.coalesce(safe_div(F.col("n"), row_total), F.lit(0.0)).alias("share"))

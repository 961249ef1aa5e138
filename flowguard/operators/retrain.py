"""Retraining run (R16): gate → merge → train → register → activate →
archive, composed from the review and registry operators. Every dataset
written is a new versioned folder (no in-place rewrite, so no rollback copy
is needed). The registry and the audit are tables of numbered commits under
the base folder: one registry row per trained version, one audit row per run,
whether it succeeded, was skipped or failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table_log
from . import evaluation as ev
from . import models as md
from . import registry as rg
from . import review as rv

SCHEMA = ("status string, version string, previous_version string, approved long, train_rows long, merged_rows long, "
          "accuracy double, precision_macro double, recall_macro double, f1_macro double, f1_weighted double, "
          "archived long, remaining long, message string")
REGISTRY = "version string, model string, params string, accuracy double, precision_macro double, recall_macro double, f1_macro double, f1_weighted double"


def registry(spark: SparkSession, base_path: str) -> DataFrame:
    return table_log.read(spark, f"{base_path}/registry", REGISTRY)


def audit(spark: SparkSession, base_path: str) -> DataFrame:
    return rg.audit(spark, f"{base_path}/audit")


def active_version(spark: SparkSession, base_path: str) -> str | None:
    """The version of the last successful activation."""
    return rg.active_version(audit(spark, base_path)).first()["version"]


def run(spark: SparkSession, train: DataFrame, test: DataFrame, features: Sequence[str], validated: DataFrame,
        next_version: str, base_path: str, model_name: str = "random_forest", label: str = "class1",
        input_col: str = "duration", minimum: int = rv.RETRAIN_MIN_LABELS) -> DataFrame:
    """One row with the outcome. Below ``minimum`` approved labels the run is
    skipped; an error while training or writing makes it failed, and the
    active version stays."""
    previous = active_version(spark, base_path)
    appr = rv.approved(validated, input_col=input_col)
    n_appr = appr.count()

    def outcome(status: str, message: str | None, **values) -> DataFrame:
        rg.record(spark, f"{base_path}/audit", previous, next_version if status != "skipped" else None, status, message)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        values |= dict(status=status, version=next_version if status != "skipped" else None, previous_version=previous, approved=n_appr, message=message)
        return spark.createDataFrame([tuple(values.get(n) for n in names)], SCHEMA)

    if n_appr < minimum:
        return outcome("skipped", f"{n_appr} approved labels of {minimum}", archived=0)
    try:
        # merge: approved inputs conformed to the model columns (missing → 0)
        new_rows = appr.select(F.col("validated_label").alias(label),
                               *[(F.col(c) if c in appr.columns else F.lit(0.0)).cast("double").alias(c) for c in features])
        merged_path = f"{base_path}/training/{next_version}"
        train.select(label, *features).unionByName(new_rows).write.mode("errorifexists").parquet(merged_path)
        merged = spark.read.parquet(merged_path)
        model, _, classes = md.fit(model_name, merged, features, label)
        scored = md.score(model, test, features, classes).withColumn("_g", F.lit(1))
        rep = ev.macro_weighted(ev.per_class_report(scored, ["_g"], label, "pred_type"), ["_g"]).first().asDict()
        rep["accuracy"] = ev.accuracy(scored, ["_g"], {"accuracy": (label, "pred_type")}).first()["accuracy"]
        md.save(model, spark, f"{base_path}/models/{next_version}")
        metrics = {k: float(rep[k]) for k in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")}
        table_log.append(spark.createDataFrame([(next_version, model_name, md.params(model), *metrics.values())], REGISTRY).coalesce(1), f"{base_path}/registry")
        # archive: processed records leave the validated table (new snapshot)
        remaining = rv.archive(validated, appr)
        remaining.write.mode("errorifexists").json(f"{base_path}/validated/{next_version}")
        appr.write.mode("errorifexists").json(f"{base_path}/processed/{next_version}")
        counts = dict(train_rows=train.count(), merged_rows=merged.count(), archived=n_appr, remaining=remaining.count())
    except Exception as exc:  # the outcome of a run, whatever ended it
        return outcome("failed", f"{type(exc).__name__}: {str(exc)[:200]}")
    return outcome("success", None, **counts, **metrics)

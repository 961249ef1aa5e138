"""Model registry as tables (R11–R15, E17, L3, O7, O8): versions with
metrics, an audit log of activations (``sources/table_log``), and views over
both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import table_log
from . import evaluation as ev
from .joins import small
from .ordering import last_before

VERSION_PREFIX = "RF_v"


def version_number(col: str = "version"):
    return F.regexp_extract(F.col(col), r"^RF_v([0-9]+)$", 1).cast("long")


def registry_from_scores(scores: DataFrame, derived: DataFrame) -> DataFrame:
    """One version per (model, split) evaluation, numbered in (model, split)
    order; the table is as small as the number of evaluated models."""
    acc = ev.accuracy(derived, ["model", "split"], {"accuracy": ("true_type", "pred_type")})
    wt = ev.macro_weighted(ev.per_class_report(derived, ["model", "split"], "true_type", "pred_type"), ["model", "split"]).select(
        "model", "split", "f1_weighted")
    j = scores.select("model", "split", F.col("f1_type").alias("f1_macro")).join(acc, ["model", "split"]).join(wt, ["model", "split"])
    n = F.row_number().over(Window.orderBy("model", "split"))
    return j.select(F.concat(F.lit(VERSION_PREFIX), n.cast("string")).alias("version"), "accuracy", "f1_macro", "f1_weighted", "model", "split")


def quality_alerts(reg: DataFrame, minimum: float) -> DataFrame:
    """f1_macro below the minimum → critical; a missing metric → no decision."""
    return reg.filter(F.col("f1_macro").isNotNull() & (F.col("f1_macro") < F.lit(minimum))).withColumn("severity", F.lit("critical"))


def next_version(reg: DataFrame) -> DataFrame:
    return reg.agg(F.concat(F.lit(VERSION_PREFIX), (F.coalesce(F.max(version_number()), F.lit(0)) + 1).cast("string")).alias("next_version"))


def list_models(reg: DataFrame) -> DataFrame:
    """Versions in numeric order (RF_v10 after RF_v9)."""
    return reg.withColumn("ordinal", version_number().cast("long"))


AUDIT = "seq long, previous_model string, new_model string, status string, detail string"


def select_versions(requests: DataFrame, reg: DataFrame, base: str) -> int:
    """Carries out selection requests ``(seq, version)`` in the order of
    ``seq`` and appends one event each to the audit log at ``base``, as one
    commit, whose number it returns. A version of the registry becomes active
    (success), any other one, null included, does not (failed);
    ``previous_model`` is the version that was active just before. Requests
    are joined to the registry, whatever their number; if another writer
    commits meanwhile the events are made again from its state."""
    spark = requests.sparkSession
    known = reg.select("version", F.lit(True).alias("_known")).distinct()
    asked = requests.select("seq", "version").join(small(known), "version", "left").select("seq", "version", F.coalesce("_known", F.lit(False)).alias("_known"))
    ordered = last_before(asked.withColumn("_ok", F.when(F.col("_known"), F.col("version"))), "_ok", ["seq", "version"], "_previous")
    while True:
        at = table_log.version(spark, base)
        active = active_version(audit(spark, base, at)).first()["version"]
        events = ordered.select(
            "seq", F.coalesce("_previous", F.lit(active)).alias("previous_model"), F.col("version").alias("new_model"),
            F.when(F.col("_known"), "success").otherwise("failed").alias("status"),
            F.when(F.col("_known"), F.concat(F.lit("active version is now "), "version"))
            .otherwise(F.concat(F.lit("no such version: "), F.coalesce("version", F.lit("none")))).alias("detail"))
        try:
            return table_log.append(events, base, expected=at)
        except table_log.Conflict:
            continue


def record(spark: SparkSession, base: str, previous: str | None, version: str | None, status: str, detail: str | None) -> int:
    """Appends one event, such as a retraining run's outcome, to the audit
    log; returns its commit."""
    event = spark.createDataFrame([(None, previous, version, status, detail)], AUDIT)
    return table_log.append(event.coalesce(1), base)


def audit(spark: SparkSession, base: str, at: int | None = None) -> DataFrame:
    """Events of the audit log, with the number of their ``commit``, which is
    also the ``seq`` of an event without one; they happened in the order of
    (commit, seq)."""
    events = table_log.read(spark, base, AUDIT, at, number_out="commit")
    return events.withColumn("seq", F.coalesce("seq", "commit"))


def active_version(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("status") == "success").agg(F.max_by("new_model", F.struct("commit", "seq")).alias("version"))


def history(audit: DataFrame, n: int = 20) -> DataFrame:
    if not 1 <= n <= 500:
        raise ValueError("limit must be in 1..500")
    return audit.orderBy(F.col("commit").desc(), F.col("seq").desc()).limit(n)


def summary(reg: DataFrame, audit: DataFrame) -> DataFrame:
    return reg.join(active_version(audit), "version")


def last_status_flags(audit: DataFrame) -> DataFrame:
    last = audit.agg(F.max_by("status", F.struct("commit", "seq")).alias("s"))
    return last.select(*[(F.col("s") == st).cast("int").alias(st) for st in ("success", "skipped", "failed")])


def active_flags(reg: DataFrame, audit: DataFrame) -> DataFrame:
    active = active_version(audit).first()["version"]
    return reg.select("version", F.coalesce((F.col("version") == F.lit(active)).cast("int"), F.lit(0)).alias("active"))

"""Review queue, label validation and retraining data (R1–R10).

Queue and validated tables are append-only; "minus" is a ``left_anti`` join
on the sample id (NULL ids never match on the validated side), and the
archive step uses a null-safe anti join so a processed record without id
removes every id-less row, as in the reference.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .drift import REASON_SAMPLE, REASON_WINDOW
from .joins import small
from .ordering import positions

DEFAULT_REASON = "sample_out_of_profile"
RETRAIN_MIN_LABELS = 50
RETRAIN_MAX_BATCHES = 1000
RETRAIN_INTERVAL_SECONDS = 3600


def enqueue(rolled: DataFrame, batch: str, pos: str, sample_threshold: float, mode: str = "batch") -> DataFrame:
    """Rows to send to review. ``batch`` mode: the status after the LAST row
    of a batch decides for every row of the batch (reference behaviour);
    ``row`` mode: each row by its own status."""
    reason = F.when(F.col("window_alert"), REASON_WINDOW).when(F.col("sample_alert"), REASON_SAMPLE)
    send = F.col("alert_active") | (F.col("score") >= F.lit(sample_threshold))
    x = rolled.withColumns({"_reason": reason, "_send": send})
    if mode == "row":
        return x.filter("_send").withColumn("review_reason", F.coalesce("_reason", F.lit(DEFAULT_REASON))).drop("_reason", "_send")
    last = x.groupBy(batch).agg(F.max_by(F.struct("_send", "_reason"), F.col(pos)).alias("_l"))
    j = x.drop("_send", "_reason").join(last, batch)
    return j.filter(F.col("_l._send")).withColumn("review_reason", F.coalesce(F.col("_l._reason"), F.lit(DEFAULT_REASON))).drop("_l")


def prediction_log(rolled: DataFrame, batch: str, pos: str) -> DataFrame:
    """One record per batch: inputs in position order, mean score and the
    alert state after the batch. The list is per batch (bounded by the batch
    size), never per table."""
    g = rolled.groupBy(batch).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("sample_id")))).alias("_in"),
        F.avg("score").alias("mean_score"),
        F.max_by("alert_active", F.col(pos)).alias("alert_active"),
    )
    return g.select(batch, "n_rows", F.array_join(F.transform("_in", lambda s: s["sample_id"]), ",").alias("inputs"),
                    F.round("mean_score", 6).alias("mean_score"), "alert_active")


def pending(queue: DataFrame, validated: DataFrame, limit: int = 50, order: str = "seq") -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be in 1..500")
    p = queue.join(validated.select("sample_id").filter(F.col("sample_id").isNotNull()), "sample_id", "left_anti")
    # newest first: a top-N report bounded by the limit
    return p.orderBy(F.col(order).desc()).limit(limit)


def pending_count(queue: DataFrame, validated: DataFrame) -> DataFrame:
    p = queue.join(validated.select("sample_id").filter(F.col("sample_id").isNotNull()), "sample_id", "left_anti")
    return p.agg(F.count(F.lit(1)).cast("long").alias("pending"))


def apply_labels(subs: DataFrame, queue: DataFrame, validated: DataFrame, classes: DataFrame) -> DataFrame:
    """Verdict per submission: unknown_id (404), already_validated (409,
    including a repeat of an id in the same batch: the first one wins),
    unknown_label (400), approved."""
    q = queue.select("sample_id").distinct().withColumn("_in_q", F.lit(True))
    v = validated.select("sample_id").filter(F.col("sample_id").isNotNull()).distinct().withColumn("_in_v", F.lit(True))
    c = small(classes.select(F.col("label").alias("_lbl")).distinct().withColumn("_ok", F.lit(True)))
    s = subs.withColumn("_lbl", F.lower(F.trim("validated_label")))
    # first submission per id wins: an aggregate (partial per task, so an id
    # submitted very often is not one task) joined back on (id, seq)
    first = subs.groupBy("sample_id").agg(F.min("submit_seq").alias("submit_seq")).withColumn("_first", F.lit(True))
    s = s.join(first, ["sample_id", "submit_seq"], "left")
    j = s.join(q, "sample_id", "left").join(v, "sample_id", "left").join(c, "_lbl", "left")
    verdict = (
        F.when(F.col("_in_q").isNull(), "unknown_id")
        .when(F.col("_first").isNull() | F.col("_in_v").isNotNull(), "already_validated")
        .when(F.col("_ok").isNull(), "unknown_label")
        .otherwise("approved")
    )
    return j.select(*subs.columns, verdict.alias("verdict"), F.when(F.col("_ok"), F.col("_lbl")).alias("label"))


def approved(validated: DataFrame, input_col: str = "input") -> DataFrame:
    return validated.filter((F.col("review_status") == "approved") & (F.col("validated_label") != "") & F.col(input_col).isNotNull())


def retrain_gate(approved_rows: DataFrame, minimum: int = RETRAIN_MIN_LABELS) -> DataFrame:
    n = F.count(F.lit(1))
    return approved_rows.agg(n.cast("long").alias("approved"), (n >= minimum).alias("run"),
                             F.when(n >= minimum, "run").otherwise("skipped").alias("decision"))


# --- every retraining trigger of a log (R8) --------------------------------
#
# After a run the batch counter and the clock start again, so whether a batch
# triggers depends on all triggers before it. But from a trigger the next one
# is known: the first batch with an active alert, or ``interval`` after it, or
# ``max_batches`` further on. The log is cut into blocks no shorter than
# ``max_batches``, so a link ends in the same block or the next one, and a
# block is a function from the place of its first trigger (``max_batches`` of
# them at most) to that of the next block's. Functions compose associatively:
# groups of blocks are composed in a tree, entries are handed down the tree,
# and each block is replayed from its entry in a task of its own.

TRIGGER_BLOCK = 16_384
TRIGGER_FAN = 256  # functions that one step of the tree composes
_NONE = -1


def _next_triggers(ts: np.ndarray, active: np.ndarray, n: int, most: int, interval: float) -> np.ndarray:
    """For each of the first ``n`` batches the place of the next trigger if
    this one is a trigger; ``_NONE`` where the log ends before."""
    out = np.full(n, _NONE, np.int64)
    for i in range(n):
        hits = active[i + 1 : i + 1 + most] | (ts[i + 1 : i + 1 + most] - ts[i] >= interval)
        first = int(hits.argmax()) if len(hits) else 0
        if len(hits) and hits[first]:
            out[i] = i + 1 + first
        elif len(hits) == most:
            out[i] = i + most
    return out


def _compose(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """First f, then g; no trigger stays none."""
    return np.where(f == _NONE, _NONE, g[np.maximum(f, 0)])


def _entries(blocks: DataFrame, first: int, most: int) -> DataFrame:
    """(block, entry): the place of each block's first trigger, from the
    blocks' functions (block, fn) and the entry of the first block."""
    spark = blocks.sparkSession
    levels = [blocks]
    while levels[-1].count() > TRIGGER_FAN:

        def up(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block")
            fns = [np.asarray(f) for f in pdf["fn"]]
            return pd.DataFrame({"block": [int(pdf["block"].iloc[0]) // TRIGGER_FAN], "fn": [reduce(_compose, fns)]})

        path = scratch_path(spark, "trigger-functions")
        levels[-1].groupBy(F.floor(F.col("block") / TRIGGER_FAN)).applyInPandas(up, "block long, fn array<bigint>").write.parquet(path)
        levels.append(spark.read.parquet(path))
    known = []
    entry = first
    for r in levels[-1].orderBy("block").collect():  # at most TRIGGER_FAN functions
        known.append((r["block"], entry))
        entry = _NONE if entry == _NONE else r["fn"][entry]
    out = spark.createDataFrame(known, "block long, entry long")
    for level in reversed(levels[:-1]):

        def down(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, at, got = pdf.sort_values("block"), int(pdf["entry"].iloc[0]), []
            for fn in pdf["fn"]:
                got.append(at)
                at = _NONE if at == _NONE else int(fn[at])
            return pd.DataFrame({"block": pdf["block"], "entry": got})

        of = out.withColumnRenamed("block", "up")
        out = level.withColumn("up", F.floor(F.col("block") / TRIGGER_FAN)).join(of, "up").groupBy("up").applyInPandas(down, "block long, entry long")
    return out


def retrain_triggers(batches: DataFrame, order: str, ts: str, active: str, max_batches: int = RETRAIN_MAX_BATCHES,
                     interval: int = RETRAIN_INTERVAL_SECONDS, block: int = TRIGGER_BLOCK) -> DataFrame:
    """Every batch that starts a retraining run: ``order``, reason, batches
    and seconds since the run before (or since the log began). Reasons by
    priority: ``batches`` (``max_batches`` since then), ``drift`` (an alert is
    active), ``interval`` (as many seconds since then). A run is over before
    the next batch, and counter and clock start again with it.

    ``order`` makes the order total; a null alert is none, a null time never
    makes the interval; an empty log has no trigger."""
    most, spark = int(max_batches), batches.sparkSession
    size = max(int(block), most)
    seconds = F.unix_seconds(F.col(ts).cast("timestamp")).cast("double")
    x = batches.select(F.col(order).alias("order"), seconds.alias("ts"), F.coalesce(F.col(active), F.lit(False)).alias("active"))
    x = positions(x, ["order"], out="i")
    start = x.agg(F.min("ts")).first()[0]
    hit = F.col("active") | (F.col("ts") - F.lit(start) >= interval) | (F.col("i") == most - 1)
    first = x.where((F.col("i") < most) & hit).agg(F.min("i")).first()[0]
    if first is None:
        return spark.createDataFrame([], x.select("order", F.lit("").alias("reason"), F.lit(0).cast("long").alias("batches"), F.lit(0).cast("long").alias("seconds")).schema).withColumnRenamed("order", order)
    here = F.floor(F.col("i") / size)
    # a block and the rows behind it that its links may reach
    ahead = F.when((F.col("i") % size < most) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    path = scratch_path(spark, "trigger-blocks")
    x.withColumn("block", F.explode(ahead)).write.parquet(path)
    rows = spark.read.parquet(path)

    def links(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, int, np.ndarray]:
        pdf = pdf.sort_values("i")
        at = int(pdf["block"].iloc[0])
        n = int((pdf["i"] // size == at).sum())
        return pdf, at, n, _next_triggers(pdf["ts"].to_numpy(float), pdf["active"].to_numpy(bool), n, most, interval)

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, n, link = links(pdf)
        out = np.full(max(n, most), _NONE, np.int64)
        for i in range(n - 1, -1, -1):
            to = link[i]
            out[i] = _NONE if to == _NONE else to - n if to >= n else out[to]
        return pd.DataFrame({"block": [at], "fn": [out[:most]]})

    typed = x.schema["order"].dataType.simpleString()

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = int(pdf["entry"].iloc[0])
        pdf, at, n, link = links(pdf)
        rows, to = [], entry
        names, times, alerts, place = pdf["order"].to_numpy(), pdf["ts"].to_numpy(float), pdf["active"].to_numpy(bool), pdf["i"].to_numpy()
        while to != _NONE and to < n:
            rows.append((names[to], int(place[to]), times[to], bool(alerts[to])))
            to = int(link[to])
        return pd.DataFrame(rows, columns=["order", "i", "ts", "active"])

    fns = scratch_path(spark, "trigger-functions")
    rows.groupBy("block").applyInPandas(function, "block long, fn array<bigint>").write.parquet(fns)
    entries = _entries(spark.read.parquet(fns), int(first), most)
    found = rows.join(small(entries.where(F.col("entry") != _NONE)), "block")
    path = scratch_path(spark, "triggers")
    found.groupBy("block").applyInPandas(replay, f"order {typed}, i long, ts double, active boolean").write.parquet(path)
    fired = positions(spark.read.parquet(path), ["i"], out="nth")
    # the run before each: the trigger one place earlier, or the start of the log
    last = fired.select((F.col("nth") + 1).alias("nth"), F.col("i").alias("last_i"), F.col("ts").alias("last_ts"))
    since = fired.join(last, "nth", "left").withColumns({
        "batches": F.col("i") - F.coalesce("last_i", F.lit(-1)),
        "seconds": (F.col("ts") - F.coalesce("last_ts", F.lit(start))).cast("long"),
    })
    reason = F.when(F.col("batches") >= most, "batches").when(F.col("active"), "drift").otherwise("interval")
    return since.select(F.col("order").alias(order), reason.alias("reason"), F.col("batches").cast("long").alias("batches"), "seconds")


def merge_training(train: DataFrame, approved_rows: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Approved review inputs conformed to the training columns (missing → 0)
    and appended; written as a new version by the caller."""
    t = train.select(F.lit("train").alias("source"), F.col(label).alias("label"),
                     *[(F.col(c) if c in train.columns else F.lit(0.0)).cast("double").alias(c) for c in features])
    a = approved_rows.select(F.lit("review").alias("source"), F.col("validated_label").alias("label"),
                             *[(F.col(c) if c in approved_rows.columns else F.lit(0.0)).cast("double").alias(c) for c in features])
    return t.unionByName(a)


def archive(validated: DataFrame, processed: DataFrame) -> DataFrame:
    """Validated minus processed, null-safe on the id."""
    p = processed.select(F.col("sample_id").alias("_pid")).distinct()
    return validated.join(p, validated["sample_id"].eqNullSafe(p["_pid"]), "left_anti")


def progress(queue: DataFrame, validated: DataFrame, minimum: int = RETRAIN_MIN_LABELS, input_col: str = "duration") -> DataFrame:
    """Pending reviews, validated samples, how many a retraining run needs, and
    the share of them that is there, in per cent (above 100 with more)."""
    pc = pending_count(queue, validated).withColumn("_k", F.lit(1))
    ap = approved(validated, input_col).agg(F.count(F.lit(1)).cast("long").alias("validated")).withColumn("_k", F.lit(1))
    return pc.join(ap, "_k").select("pending", "validated", F.lit(minimum).alias("minimum"), (F.col("validated") * 100.0 / minimum).alias("progress_percent"))

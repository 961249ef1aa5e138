"""Streaming operational alerts (L9) and request rate (O4 on a stream).

* ``alert_stream``: per source, the last N requests and the last send of each
  alert are carried from micro-batch to micro-batch (``carry``); in
  ``foreachBatch`` each request gives the window size, error count, rate,
  nearest-rank p95 and both alert flags by ``operators.alerts.request_windows``
  and whether a firing alert is sent, by ``operators.alerts.cooldown`` since
  its last send. Both cut a source into blocks, so no task holds all its rows.
  A reset in the stream (``RESET_ENDPOINT``) clears the sends and the active
  alerts of all sources, not their windows. ``active_alerts`` is the table of
  alerts that the last evaluated request of a source triggered; the first one
  that doesn't fire resolves it. State is written beside the checkpoint per
  micro-batch, so a restart goes on from it.
  ``trailing_p95`` and ``cooled`` are the same rules one row after the other,
  against which the stream is tested.
* ``rate_stream``: requests per minute per endpoint. Counts of a window are
  written as they grow (update mode, one file set for each micro-batch) and
  the newest one is read, so no request is late and no window stays open.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators.joins import small
from ..operators.ordering import positions
from ..session import scratch_path
from .carry import earlier, numbers, with_carry, with_epochs, written
from .sources import read_batches, write_batches

OUT = ("seq long, source_id long, window_n long, errors long, error_rate double, p95_latency double, "
       "error_rate_alert boolean, latency_alert boolean, error_rate_sent boolean, latency_sent boolean")
LAST_SENDS = "k string, last long"
FLAGS = ("error_rate", "latency")
ACTIVE = "alert string, source_id long, epoch long, seq long, second long, cooldown_active boolean"
RESET_ENDPOINT = "/admin/alerts/reset"


def trailing_p95(durations: np.ndarray, first: int, size: int) -> np.ndarray:
    """Nearest-rank p95 of the last ``size`` values at each position from
    ``first`` on; numpy rounds half to even, like the batch rule."""
    out = np.empty(len(durations) - first)
    short = max(0, min(size - 1, len(durations)) - first)
    for i in range(short):
        s = np.sort(durations[: first + i + 1])
        out[i] = s[int(np.round((len(s) - 1) * 0.95))]
    if first + short < len(durations):
        full = np.sort(np.lib.stride_tricks.sliding_window_view(durations, size)[first + short - size + 1 :], axis=1)
        out[short:] = full[:, int(np.round((size - 1) * 0.95))]
    return out


def cooled(fires: np.ndarray, seconds: np.ndarray, last: int | None, cooldown: int) -> tuple[np.ndarray, int | None]:
    """Which firing requests are sent: the first one, then the first at least
    ``cooldown`` seconds after the one sent before."""
    sent = np.zeros(len(fires), bool)
    for i in np.flatnonzero(fires):
        if last is None or seconds[i] - last >= cooldown:
            sent[i], last = True, int(seconds[i])
    return sent, last


def sends(fired: DataFrame, cooldown: int, block: int = 10_000) -> DataFrame:
    """(k, t, seq): the sent ones of the firing requests (k, second, seq, last),
    as ``cooled`` finds them in the order of ``seq``. Only a second above all
    firing seconds before it can be sent, and only from ``last`` + cooldown
    on; among these, in order of time, it is the batch cooldown."""
    able = fired.filter(F.col("last").isNull() | (F.col("second") - F.col("last") >= cooldown))
    x = positions(able, order_by=["seq"], partition_by=["k"], out="_at").withColumn("_part", F.floor(F.col("_at") / block))
    tops = x.groupBy("k", "_part").agg(F.max("second").alias("_top"))
    upto = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("k").alias("_k"), F.col("_part").alias("_p"), F.max("_top").over(upto).alias("_before"))
    x = x.join(tops, (F.col("k") == F.col("_k")) & (F.col("_part") == F.col("_p")))
    here = F.max("second").over(Window.partitionBy("k", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    highest = F.greatest(here, F.col("_before"))
    records = x.withColumn("_highest", highest).filter(F.col("_highest").isNull() | (F.col("second") > F.col("_highest")))
    records = records.select("k", F.col("second").alias("t"), "seq")
    sent = al.cooldown(records.withColumn("ts", F.timestamp_seconds("t")), "k", "ts", cooldown)
    return records.join(sent, ["k", "t"])


def batch_writer(sink: str, ckpt: str, cooldown: int, block: int | None = None):
    """What ``foreachBatch`` does; a repeated batch writes the same rows again
    to the same folders."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch, epoch = with_epochs(batch, number, f"{ckpt}/epoch", F.col("endpoint") == RESET_ENDPOINT, ["seq"])
        rows = with_carry(batch, number, f"{ckpt}/carried", "source_id", ["seq"], al.REQUEST_WINDOW - 1)
        seen = al.request_windows(rows, partition_by=["source_id"], with_positions=False, block=block).filter("_new")
        seen = written(seen.drop("_new", "endpoint"), f"{ckpt}/windows/batch-{number}")
        # sends of a key count until the next reset: the epoch is part of the key
        key = lambda f: F.concat_ws(":", F.lit(f), F.col("source_id").cast("string"), F.col("epoch").cast("string"))
        alerts = F.explode(F.array(*[F.struct(key(f).alias("k"), F.col(f"{f}_alert").alias("fires")) for f in FLAGS]))
        fired = seen.select("seq", "second", alerts.alias("a")).filter("a.fires").select("a.k", "seq", "second")
        last = earlier(spark.createDataFrame([], LAST_SENDS), f"{ckpt}/sends", number)
        sent = written(sends(fired.join(small(last), "k", "left"), cooldown), f"{ckpt}/sent/batch-{number}")
        now = last.unionByName(sent.select("k", F.col("t").alias("last"))).groupBy("k").agg(F.max("last").alias("last"))
        now.filter(F.element_at(F.split("k", ":"), -1) == str(epoch)).write.mode("overwrite").parquet(f"{ckpt}/sends/batch-{number}")
        flags = sent.groupBy(F.col("seq").alias("_seq")).agg(*[F.max(F.split("k", ":")[0] == f).alias(f"{f}_sent") for f in FLAGS])
        out = seen.join(flags, F.col("seq") == F.col("_seq"), "left").withColumns({f"{f}_sent": F.coalesce(f"{f}_sent", F.lit(False)) for f in FLAGS})
        out.select("seq", "source_id", F.col("window_n").cast("long").alias("window_n"), F.col("errors").cast("long").alias("errors"), "error_rate", "p95_latency",
                   "error_rate_alert", "latency_alert", *[f"{f}_sent" for f in FLAGS]) \
            .write.mode("overwrite").parquet(f"{sink}/batch-{number}")
        active = earlier(spark.createDataFrame([], ACTIVE), f"{ckpt}/active", number)
        _active(active, out, epoch).write.mode("overwrite").parquet(f"{ckpt}/active/batch-{number}")

    return write


def _active(before: DataFrame, out: DataFrame, epoch: int) -> DataFrame:
    """The active alerts after a micro-batch: those before and the newest
    evaluated request of each source in it, the newer of both by alert and
    source, if it fires and no reset came since."""
    fires = F.explode(F.array(*[F.struct(F.lit(f).alias("alert"), F.col(f"{f}_alert").alias("fires"), (~F.col(f"{f}_sent")).alias("cooldown_active")) for f in FLAGS]))
    new = out.filter("evaluated").select("source_id", "epoch", "seq", "second", fires.alias("a")).select("*", "a.*").drop("a").withColumn("_new", F.lit(1))
    both = before.withColumn("fires", F.lit(True)).withColumn("_new", F.lit(0)).unionByName(new)
    newest = both.groupBy("alert", "source_id").agg(F.max_by(F.struct("epoch", "seq", "second", "cooldown_active", "fires"), F.struct("_new", "seq")).alias("r"))
    return newest.select("alert", "source_id", "r.*").filter(F.col("fires") & (F.col("epoch") == epoch)).drop("fires")


def run(spark: SparkSession, requests: DataFrame, cooldown: int = al.COOLDOWN_SECONDS) -> tuple[str, str]:
    """Run the alerts over ``requests`` as a stream; the folders of the sink and of the state."""
    src, sink, ckpt = scratch_path(spark, "alert-src"), scratch_path(spark, "alert-sink"), scratch_path(spark, "alert-ckpt")
    schema = write_batches(requests, src)
    s = read_batches(spark, src, schema).filter(~F.col("endpoint").isin(*al.INTERNAL_ENDPOINTS))
    s = s.select("seq", "source_id", "endpoint", "http_status", "duration", F.unix_seconds("ts").alias("second"))
    q = s.writeStream.foreachBatch(batch_writer(sink, ckpt, cooldown)).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return sink, ckpt


def alert_stream(spark: SparkSession, requests: DataFrame, cooldown: int = al.COOLDOWN_SECONDS) -> DataFrame:
    sink, _ = run(spark, requests, cooldown)
    return spark.read.schema(OUT).option("recursiveFileLookup", "true").parquet(sink)


def active_alerts(spark: SparkSession, ckpt: str) -> DataFrame:
    """The alerts active after the last micro-batch; none before the first."""
    found = numbers(spark, f"{ckpt}/active")
    if not found:
        return spark.createDataFrame([], ACTIVE)
    return spark.read.schema(ACTIVE).parquet(f"{ckpt}/active/batch-{max(found)}")


RATE_SCHEMA = "window_start long, endpoint string, n long, rate_per_second double, batch long"


def rate_stream(spark: SparkSession, requests: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    src, sink, ckpt = scratch_path(spark, "rate-src"), scratch_path(spark, "rate-sink"), scratch_path(spark, "rate-ckpt")
    schema = write_batches(requests, src)
    s = read_batches(spark, src, schema, max_files=files_per_trigger).filter(~F.col("endpoint").isin(*al.INTERNAL_ENDPOINTS))
    g = s.groupBy(F.window("ts", "1 minute").alias("w"), "endpoint").agg(F.count(F.lit(1)).alias("n"))
    out = g.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "endpoint", "n", (F.col("n") / 60.0).alias("rate_per_second"))

    def write(batch: DataFrame, number: int) -> None:
        # a repeated batch writes the same rows again to the same folder
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch-{number}")

    q = out.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(RATE_SCHEMA).option("recursiveFileLookup", "true").parquet(sink)
    newest = found.groupBy("window_start", "endpoint").agg(F.max_by(F.struct("n", "rate_per_second"), "batch").alias("r"))
    return newest.select("window_start", "endpoint", "r.n", "r.rate_per_second")

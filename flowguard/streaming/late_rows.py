"""Request rate on a stream with a watermark (O4): counts of a window are
final once the watermark has passed its end, and rows that come later are
kept in a side table instead of being dropped.

The watermark of a micro-batch is the highest event time of the micro-batches
before it, less ``delay``. A row is late if its window ends at or before it.
What ``foreachBatch`` leaves beside the checkpoint, under the number of the
micro-batch: the counts of windows still open and the highest event time. A
repeated micro-batch writes the same rows again to the same folders, and a
restart goes on from the last one. Work of a micro-batch grows with its rows
and the open windows, not with the stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import INTERNAL_ENDPOINTS
from ..session import scratch_path
from .carry import earlier, numbers, written
from .sources import read_batches

WINDOW_SECONDS = 60
COUNTS = "window_start long, endpoint string, n long"
SEEN = "highest long"


@dataclass(frozen=True)
class Rates:
    """Tables of a finished run: counts of ``closed`` windows (appended once each), of ``open`` ones, and the ``late`` rows."""

    closed: DataFrame
    open: DataFrame
    late: DataFrame

    def counted(self) -> DataFrame:
        """(window_start, endpoint, on_time, late): every row of the stream, counted in its window."""
        late = self.late.groupBy("window_start", "endpoint").agg(F.count(F.lit(1)).alias("late"))
        on_time = self.closed.unionByName(self.open).select("window_start", "endpoint", F.col("n").alias("on_time"))
        parts = on_time.withColumn("late", F.lit(0).cast("long")).unionByName(late.withColumn("on_time", F.lit(0).cast("long")))
        return parts.groupBy("window_start", "endpoint").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


def batch_writer(sink: str, ckpt: str, delay: int, window: int = WINDOW_SECONDS):
    """What ``foreachBatch`` does with rows (seq, endpoint, ts)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = earlier(spark.createDataFrame([], SEEN), f"{ckpt}/seen", number).first()
        highest = before["highest"] if before else None
        rows = batch.withColumn("_at", F.unix_micros("ts")).withColumn("window_start", F.floor(F.col("_at") / 1_000_000 / window).cast("long") * window)
        end = (F.col("window_start") + window) * 1_000_000
        is_late = F.lit(False) if highest is None else F.coalesce(end <= highest - delay * 1_000_000, F.lit(False))
        rows = written(rows.withColumn("_late", is_late), f"{ckpt}/rows/batch-{number}")
        rows.where("_late").drop("_late", "_at").write.mode("overwrite").parquet(f"{sink}/late/batch-{number}")
        old = earlier(spark.createDataFrame([], COUNTS), f"{ckpt}/open", number)
        new = rows.where("not _late").groupBy("window_start", "endpoint").agg(F.count(F.lit(1)).alias("n"))
        counts = old.unionByName(new).groupBy("window_start", "endpoint").agg(F.sum("n").alias("n"))
        counts = written(counts, f"{ckpt}/counts/batch-{number}")
        seen = rows.agg(F.max("_at").alias("highest")).first()["highest"]
        highest = max((v for v in (seen, highest) if v is not None), default=None)
        done = F.lit(False) if highest is None else F.coalesce(end <= highest - delay * 1_000_000, F.lit(False))
        counts.where(done).write.mode("overwrite").parquet(f"{sink}/closed/batch-{number}")
        counts.where(~done).write.mode("overwrite").parquet(f"{ckpt}/open/batch-{number}")
        spark.createDataFrame([(highest,)], SEEN).write.mode("overwrite").parquet(f"{ckpt}/seen/batch-{number}")

    return write


def run(stream: DataFrame, sink: str, ckpt: str, delay: int, window: int = WINDOW_SECONDS) -> Rates:
    """Run the stream of rows (seq, endpoint, ts) until its files are read.
    A row without a time has no window: it is never late and its count, under
    a null window, stays open. A repeated row counts again."""
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(batch_writer(sink, ckpt, delay, window)).option("checkpointLocation", f"{ckpt}/query").trigger(availableNow=True).start()
    q.awaitTermination()
    late_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, window_start long"
    found = numbers(spark, f"{ckpt}/open")
    if not found:  # no file came
        empty = spark.createDataFrame([], COUNTS)
        return Rates(empty, empty, spark.createDataFrame([], late_schema))
    nested, last = spark.read.option("recursiveFileLookup", "true"), max(found)
    return Rates(nested.schema(COUNTS).parquet(f"{sink}/closed"), spark.read.schema(COUNTS).parquet(f"{ckpt}/open/batch-{last}"),
                 nested.schema(late_schema).parquet(f"{sink}/late"))


def late_rates(spark: SparkSession, source: str, schema, delay: int, files_per_trigger: int = 1) -> Rates:
    """Rates of request batches that arrive as JSON files under ``source``."""
    rows = read_batches(spark, source, schema, max_files=files_per_trigger).filter(~F.col("endpoint").isin(*INTERNAL_ENDPOINTS))
    return run(rows.select("seq", "endpoint", "ts"), scratch_path(spark, "late-sink"), scratch_path(spark, "late-ckpt"), delay)

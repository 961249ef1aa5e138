"""Stream sources (A7): request batches arrive as JSON files, each record
holding an array of request rows (the body of one scoring call)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

BATCH_SIZE = 4


def write_batches(requests: DataFrame, path: str, batch_size: int = BATCH_SIZE, mode: str = "overwrite") -> T.StructType:
    """Group requests into batches of ``batch_size`` consecutive sequence
    numbers (the list per batch is bounded by ``batch_size``)."""
    b = requests.withColumn("batch_id", F.col("seq") - F.col("seq") % batch_size)
    g = b.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in requests.columns]))).alias("records"))
    g.write.mode(mode).json(path)
    return g.schema


def read_batches(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.json(path)
    return s.select("batch_id", F.explode("records").alias("r")).select("batch_id", "r.*")


def request_batches_roundtrip(spark: SparkSession, requests: DataFrame) -> DataFrame:
    src, sink, ckpt = scratch_path(spark, "req-src"), scratch_path(spark, "req-sink"), scratch_path(spark, "req-ckpt")
    schema = write_batches(requests, src)
    stream = read_batches(spark, src, schema)
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    out_schema = T.StructType([T.StructField("batch_id", T.LongType())] + [f for f in requests.schema.fields])
    return spark.read.schema(out_schema).parquet(sink)

"""Streaming drift monitor (A7 + D11): a JSON file source of scored
requests, the same compiled score expression as batch, and per source the
mean of the last N scores in ``foreachBatch``. A micro-batch is put in order
block-parallel behind the last N-1 rows of each source, which are kept beside
the checkpoint (``carry``), so a source with most rows is many tasks, and a
restart continues from them. A row whose ``reset`` is true is no sample: it
empties the windows and counters of all sources. ``_monitor`` is the same rule one row after the
other, against which the stream is tested."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import drift as dr
from ..operators.windows import trailing
from ..session import scratch_path
from .carry import with_carry, with_epochs

OUT_SCHEMA = "service string, sample_id string, pos long, rolling_score double, window_observations long"


def _monitor(size: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        scores, total = state.get if state.exists else ([], 0)
        # the rows of a micro-batch come in chunks of any order
        rows = pd.concat(list(pdfs)).sort_values(["ts", "sample_id"])
        seen = np.concatenate([np.asarray(scores, float), rows["score"].to_numpy(float)])
        upto = np.arange(len(scores), len(seen)) + 1
        n = np.minimum(upto, size)
        sums = np.concatenate([[0.0], np.cumsum(seen)])
        state.update((seen[-(size - 1):].tolist(), int(total) + len(rows)))
        yield pd.DataFrame({"service": key[0], "sample_id": rows["sample_id"].to_numpy(), "pos": int(total) + np.arange(len(rows)),
                            "rolling_score": (sums[upto] - sums[upto - n]) / n, "window_observations": n})

    return fn


def batch_writer(sink: str, ckpt: str, size: int, block: int | None = None):
    """What ``foreachBatch`` does; a repeated batch writes the same rows again
    to the same folders."""

    def write(batch: DataFrame, number: int) -> None:
        is_reset = F.col("reset") if "reset" in batch.columns else F.lit(False)
        batch, epoch = with_epochs(batch, number, f"{ckpt}/epoch", is_reset, ["ts", "sample_id"])
        rows = batch.withColumn("_window", F.concat_ws(":", F.col("epoch").cast("string"), "service"))
        rows = with_carry(rows, number, f"{ckpt}/carried", "_window", ["ts", "sample_id"], size - 1, F.col("epoch") == epoch)
        rolled = trailing(rows, ["pos"], size, lambda w: [F.avg("score").over(w).alias("rolling_score"), F.count(F.lit(1)).over(w).alias("window_observations")],
                          partition_by=["_window"], with_positions=False, block=block)
        rolled.filter("_new").select("service", "sample_id", "pos", "rolling_score", "window_observations").write.mode("overwrite").parquet(f"{sink}/batch-{number}")

    return write


def run(spark: SparkSession, source: DataFrame, ref: dr.Reference, key: str = "service") -> DataFrame:
    """Write ``source`` rows as JSON files (the request stream), run the
    monitor with an ``availableNow`` trigger into a parquet sink and return
    the sink as a table."""
    src_dir = scratch_path(spark, "stream-src")
    source.write.mode("overwrite").json(src_dir)
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    stream = spark.readStream.schema(source.schema).json(src_dir)
    more = ["reset"] if "reset" in source.columns else []
    scored = dr.row_scores(stream, ref).select(F.col(key).alias("service"), "sample_id", "ts", "score", *more)
    q = scored.writeStream.foreachBatch(batch_writer(sink, ckpt, ref.window_size)).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(OUT_SCHEMA).option("recursiveFileLookup", "true").parquet(sink)

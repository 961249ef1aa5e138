"""Positions and carried rows of a keyed stream whose micro-batches have any
size: a micro-batch is ranked block-parallel (``ordering.positions``), and the
last N-1 rows of each key are written beside the checkpoint for the next
micro-batch, under its number, so a repeated micro-batch finds the same
carry. No task holds the rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small
from ..operators.ordering import positions, running_sums


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``; what was there is replaced."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def earlier(like: DataFrame, path: str, number: int) -> DataFrame:
    """The table the micro-batch before ``number`` left; empty for the first."""
    spark = like.sparkSession
    if number == 0:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(f"{path}/batch-{number - 1}")


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches that have a folder under ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(s.getPath().getName().rsplit("-", 1)[1]) for s in fs.listStatus(p)] if fs.exists(p) else []


def with_epochs(batch: DataFrame, number: int, path: str, is_reset: Column, order_by: Sequence[str]) -> tuple[DataFrame, int]:
    """The rows of micro-batch ``number`` that are no resets, with ``epoch`` =
    resets of the stream before the row in ``order_by`` order, and the epoch
    that the micro-batch ends in, which is written for the next one. State
    kept by key and epoch starts again with a reset."""
    spark = batch.sparkSession
    before = earlier(spark.createDataFrame([], "epoch long"), path, number).first()
    base = before["epoch"] if before else 0
    marked = batch.withColumn("_reset", F.coalesce(is_reset, F.lit(False)).cast("long"))
    n = marked.agg(F.sum("_reset")).first()[0] or 0
    if n:
        marked = running_sums(marked, ["_reset"], order_by).withColumn("epoch", F.lit(base) + F.col("cum__reset")).drop("cum__reset")
    else:
        marked = marked.withColumn("epoch", F.lit(base).cast("long"))
    spark.createDataFrame([(base + n,)], "epoch long").write.mode("overwrite").parquet(f"{path}/batch-{number}")
    return marked.filter("_reset = 0").drop("_reset").withColumn("epoch", F.col("epoch").cast("long")), base + n


def with_carry(batch: DataFrame, number: int, path: str, key: str, order_by: Sequence[str], keep: int, keep_if: Column | None = None) -> DataFrame:
    """The rows of micro-batch ``number`` behind the carried ones: ``pos`` =
    position in the key's stream, ``_new`` = of this micro-batch. Writes the
    last ``keep`` rows of each key, of those that satisfy ``keep_if``, for the
    next one."""
    ranked = positions(batch, order_by=order_by, partition_by=[key], out="pos", count_out="_n")
    ranked = written(ranked, f"{path}/ranked-{number}")
    new = ranked.drop("_n")
    old = earlier(new, f"{path}/carry", number)
    base = old.groupBy(F.col(key).alias("_k")).agg((F.max("pos") + 1).alias("_base"))
    placed = ranked.join(small(base), F.col(key).eqNullSafe(F.col("_k")), "left")
    placed = placed.withColumn("_left", F.col("_n") - F.col("pos")).withColumn("pos", F.col("pos") + F.coalesce("_base", F.lit(0)))
    tail = old.unionByName(placed.filter(F.col("_left") <= keep).select(*new.columns))
    tail = tail if keep_if is None else tail.filter(keep_if)
    last = tail.groupBy(F.col(key).alias("_k")).agg(F.max("pos").alias("_last"))
    tail.join(small(last), F.col(key).eqNullSafe(F.col("_k"))).filter(F.col("pos") > F.col("_last") - keep).select(*new.columns) \
        .write.mode("overwrite").parquet(f"{path}/carry/batch-{number}")
    return placed.select(*new.columns, F.lit(True).alias("_new")).unionByName(old.withColumn("_new", F.lit(False)))

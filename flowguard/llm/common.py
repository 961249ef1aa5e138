"""Shared helpers of the text operators: tables cut from lineage, word splitting, Arrow plumbing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.session import scratch_path

#: Words of the contracts: runs without space, tab, newline, vertical tab, form feed, carriage return.
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back: lineage ends there, so a lost
    executor costs a reread, and what several consumers need is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """`df`, its session set to send Python workers at most 1000 rows at a time: texts can be long, and batches of the
    usual 10,000 of them take the memory of a worker and of the executor beside it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def map_text(df: DataFrame, keep: list[str], text_col: str, fn: Callable[[list[str]], list[list]], out: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Columns `keep` as they are, plus the columns `out` (name, Arrow type, Spark type) that `fn` makes from a list
    of texts (null: empty). `fn` returns one list for each output column. Slices of 256 rows bound the memory."""
    df = bounded(df)
    spark_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{n}` {t}" for n, _, t in out])
    types = [(n, t) for n, t, _ in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                made = fn(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(v, type=t) for v, (_, t) in zip(made, types, strict=True)],
                    names=[*keep, *(n for n, _ in types)],
                )

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, spark_schema)

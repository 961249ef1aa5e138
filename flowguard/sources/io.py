"""Sources and sinks (A1–A7): CSV with an all-string schema, JSON lines,
append-only tables, snapshot rewrites and the request stream source.

All paths live under the shared checkpoint folder (or a caller-given
shared location); nothing is written to a machine-local temp folder on a
cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

CORRUPT = "_corrupt_record"


def string_schema(columns: Sequence[str], corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in columns]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Wide CSV read as all-string columns (typing is decided later by rule);
    malformed lines land in ``_corrupt_record`` instead of failing the job."""
    return (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("nullValue", None)
        .schema(string_schema(columns))
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def roundtrip_csv(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    write_csv(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]), path)
    back = read_csv(spark, path, df.columns)
    return back.drop(CORRUPT)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One table partitioned by split (instead of one file per split and label)."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, last: int | None = None,
               order_col: str | None = None) -> DataFrame:
    """JSON lines with a declared schema (blank lines are skipped by the
    reader); ``last`` keeps the newest N by ``order_col`` (the feature of the
    reference's optional limit)."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    if last is not None and order_col:
        df = df.orderBy(F.col(order_col).desc()).limit(int(last))
    return df

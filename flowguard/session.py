"""Session helpers: builder for tests/bench, UTC, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, partitions: int = 8, app: str = "flowguard") -> SparkSession:
    """Local session used by tests and the bench; a cluster passes its own."""
    master = master or os.environ.get("FLOWGUARD_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FLOWGUARD_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Pin UTC (timestamps of the test tables are zone-less) and make sure a
    checkpoint folder exists. The cluster's ``spark.checkpoint.dir`` wins;
    a private folder is only created for local sessions that have none."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Wide feature frames alias one source column many times (one-hot
    # columns, flags); constraint propagation then grows combinatorially in
    # the optimizer (and checkpointed plans keep those constraints).
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # A table written by split has a few folders: a task keeps a file open for
    # each instead of sorting its rows by folder first, which spills wide rows.
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) on a cluster")
    own = tempfile.mkdtemp(prefix="flowguard-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)  # a local session's private folder goes with it
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"

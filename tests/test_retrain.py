"""Retraining triggers against a sequential scan."""

import random

import pytest
from pyspark.sql import functions as F

from flowguard.operators import review


def scan(rows, most, interval):
    out, last_i, last_ts = [], -1, min((t for _, t, _ in rows), default=None)
    for i, (b, t, active) in enumerate(rows):
        if i - last_i >= most or active or t - last_ts >= interval:
            out.append((b, "batches" if i - last_i >= most else "drift" if active else "interval", i - last_i, t - last_ts))
            last_i, last_ts = i, t
    return out


@pytest.mark.parametrize("share,step,seed", [(0.0, 1, 1), (0.01, 3, 2), (0.0005, 40, 3), (0.0, 0, 4)])
def test_triggers_equal_a_sequential_scan(spark, share, step, seed):
    r = random.Random(seed)
    t, rows = 0, []
    for i in range(6000):
        t += r.randint(0, 2 * step) - (r.random() < 0.05) * step  # the clock may step back
        rows.append((i * 3, t, r.random() < share))
    df = spark.createDataFrame(rows, "b long, t long, active boolean").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    got = review.retrain_triggers(df, "b", "ts", "active", max_batches=70, interval=200, block=128)
    assert sorted(tuple(x) for x in got.collect()) == scan(rows, 70, 200)


def test_triggers_through_several_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(review, "TRIGGER_FAN", 3)
    rows = [(i, i * 10, i % 97 == 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "b long, t long, active boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = review.retrain_triggers(df, "b", "ts", "active", max_batches=20, interval=10**6, block=20)
    assert sorted(tuple(x) for x in got.collect()) == scan(rows, 20, 10**6)


def test_triggers_of_odd_logs(spark):
    empty = spark.createDataFrame([], "b long, ts timestamp, active boolean")
    assert review.retrain_triggers(empty, "b", "ts", "active").collect() == []
    quiet = spark.range(50).select(F.col("id").alias("b"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("boolean").alias("active"))
    assert review.retrain_triggers(quiet, "b", "ts", "active", max_batches=60).collect() == []
    assert [x.b for x in review.retrain_triggers(quiet, "b", "ts", "active", max_batches=20).orderBy("b").collect()] == [19, 39]

"""Kernel tests on small hand-made frames: positions, running sums, blocked
windows, quantiles, typing rules, cooldown, drift scoring edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowguard.functions.expressions import parse_number
from flowguard.operators import alerts, clean, drift, features, ordering, sampling, stats, windows


def test_positions_global_and_keyed_match_row_number(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c"]), rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    g = ordering.positions(df, ["v", "id"], out="pos", count_out="n", num_partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")) - 1)
    j = g.join(ref, "id")
    assert j.filter(F.col("pos") != F.col("rn")).count() == 0
    assert j.agg(F.min("n"), F.max("n")).first() == (3000, 3000)
    k = ordering.positions(df, ["v", "id"], partition_by=["k"], out="pos", count_out="n", num_partitions=7)
    ref2 = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    assert k.join(ref2.select("id", "rn"), "id").filter(F.col("pos") != F.col("rn")).count() == 0


def test_positions_many_keys_and_hot_key(spark):
    # a hot key with a third of the rows plus many small keys
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 37}", (i * 7919) % 101) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    k = ordering.positions(df, ["v", "id"], partition_by=["k"], out="pos", count_out="n", num_partitions=16)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1).withColumn(
        "rc", F.count(F.lit(1)).over(Window.partitionBy("k")))
    j = k.join(ref.select("id", "rn", "rc"), "id")
    assert j.count() == 2000
    assert j.filter((F.col("pos") != F.col("rn")) | (F.col("n") != F.col("rc"))).count() == 0


def test_ranges_are_monotone_and_spread_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else "cold", i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    b = ordering.ranged(df, ["k", "v", "id"], 8)
    ranges = b.groupBy("_bkt").agg(F.min(F.struct("k", "v", "id")).alias("lo"), F.max(F.struct("k", "v", "id")).alias("hi")).orderBy("_bkt").collect()
    for a, c in zip(ranges, ranges[1:]):
        assert tuple(a["hi"]) < tuple(c["lo"])
    assert b.filter(F.col("k") == "hot").select("_bkt").distinct().count() >= 4


def test_positions_in_1000_partitions_keep_a_small_plan(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") * 7919 % 104729).alias("v"))
    out = ordering.positions(df, ["v", "id"], out="pos", num_partitions=1000)
    assert len(out._jdf.queryExecution().toString()) < 20_000
    got = out.toPandas().sort_values(["v", "id"])
    assert got["pos"].tolist() == list(range(20_000))


def test_split_cuts_equal_ranks_and_shuffle_no_rows(spark):
    rows = [(f"k{i}", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(7000)]
    df = spark.createDataFrame(rows, "id string, s string")
    out = sampling.stratified_split(df, "id", "s", 0.15, 0.15, seed="7")
    w = Window.partitionBy("s").orderBy(F.md5(F.concat("id", F.lit("7"))), "id")
    n = F.count("*").over(Window.partitionBy("s"))
    ref = df.select("id", F.row_number().over(w).alias("rn"), n.alias("n"))
    want = F.when(F.col("rn") <= F.bround(F.col("n") * 0.15, 0), "test").when(F.col("rn") <= F.bround(F.col("n") * 0.3, 0), "val").otherwise("train")
    joined = out.join(ref, "id").withColumn("want", want)
    assert joined.count() == 7000 and joined.where("split <> want").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "RangePartitioning" not in plan.replace("rangepartitioning", "RangePartitioning")


def test_samples_take_the_first_rows_in_hash_order(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("s"))
    first = [r.id for r in df.orderBy(F.md5(F.concat("id", F.lit("42"))), "id").limit(700).collect()]
    assert sorted(r.id for r in sampling.uniform_sample(df, "id", 700).collect()) == sorted(first)
    assert sampling.uniform_sample(df, "id", 9999).count() == 5000
    got = sampling.stratified_sample(df, "id", "s", 400)
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"a": 100, "b": 300}
    assert sampling.stratified_split(df.limit(0), "id", "s").count() == 0 == sampling.uniform_sample(df.limit(0), "id", 5).count()


def test_profile_of_empty_and_single_features(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (5.0, None)], "a double, b double")
    got = drift.profile_stats(df, ["a", "b"])
    assert got["a"]["median"] == 3.0 and got["a"]["iqr"] == 2.0 and got["b"] == dict(mean=0.0, median=0.0, std=1.0, iqr=1.0, q_low=0.0, q_high=0.0)


def test_running_sums_match_window(spark):
    rows = [(i, "x" if i % 3 else "y", float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    r = ordering.running_sums(df, ["v"], ["id"], partition_by=["k"], num_partitions=5)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w))
    assert r.join(ref.select("id", "ref"), "id").filter(F.abs(F.col("cum_v") - F.col("ref")) > 1e-9).count() == 0


def test_blocked_trailing_window_equals_global_window(spark):
    rows = [(i, float((i * 37) % 11)) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, v double")
    out = windows.trailing(df, ["id"], 100, lambda w: [F.avg("v").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n")],
                           block=300)
    w = Window.orderBy("id").rowsBetween(-99, 0)
    ref = df.select("id", F.avg("v").over(w).alias("rm"), F.count(F.lit(1)).over(w).alias("rn"))
    j = out.join(ref, "id")
    assert j.count() == 2500
    assert j.filter((F.abs(F.col("m") - F.col("rm")) > 1e-12) | (F.col("n") != F.col("rn"))).count() == 0


def test_quantiles_equal_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(3).normal(size=777)] + [None, float("nan")]
    df = spark.createDataFrame([(v, 1.0) for v in vals], "a double, b double")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    clean_vals = np.array([v for v in vals if v is not None and not math.isnan(v)])
    q = {r["feature"]: r for r in stats.quantiles(df, ["a", "b"], probs).collect()}
    for i, p in enumerate(probs):
        assert q["a"][f"q_{i}"] == pytest.approx(float(np.quantile(clean_vals, p)), rel=1e-12)
    assert q["b"]["q_2"] == 1.0


def test_quantiles_all_null_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    q = {r["feature"]: r for r in stats.quantiles(df, ["a", "b"], [0.5]).collect()}
    assert q["a"]["n"] == 0 and q["a"]["q_0"] is None
    assert q["b"]["q_0"] == 1.5


def test_number_guard_rejects_suffixes(spark):
    df = spark.createDataFrame([("1d",), ("1f",), ("1_0",), (" 12 ",), ("1e5",), ("inf",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_number("s")).collect()]
    assert got[:3] == [None, None, None]
    assert got[3] == 12.0 and got[4] == 1e5 and got[5] == float("inf") and got[6] is None and got[7] is None


def test_type_rules(spark):
    df = spark.createDataFrame([("true", "1", "x"), ("false", "2", "y"), ("true", "-", None), (None, "3", "z")], "a string, b string, c string")
    t = clean.null_tokens(df)
    plan = clean.infer_types(t, 0.7)
    assert plan.kinds == {"a": "bool", "b": "double", "c": "string"}
    half = spark.createDataFrame([("true",), ("true",)], "a string")
    assert clean.infer_types(half).kinds == {"a": "string"}


def test_zero_variance_and_undefined_correlation(spark):
    df = spark.createDataFrame([(1.0, None, 1.0, 0), (1.0, None, 2.0, 1), (1.0, 5.0, 3.0, 0)], "c double, n double, x double, y int")
    zv = {r["feature"]: r["decision"] for r in features.zero_variance(df, ["c", "n", "x"]).collect()}
    assert zv == {"c": "drop", "n": "keep", "x": "keep"}
    tc = {r["feature"]: (r["abs_corr"], r["decision"]) for r in features.target_correlation(df, ["c", "x"], F.col("y")).collect()}
    assert tc["c"] == (None, "keep")  # constant column: undefined, kept (no ANSI error)


def _greedy(times, c):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= c:
            out.append(t)
            last = t
    return out


def test_cooldown_equals_sequential_scan(spark):
    rnd = random.Random(11)
    rows = []
    for k in ("hot", "a", "b"):
        n = 4000 if k == "hot" else 200
        t = 1_700_000_000
        for _ in range(n):
            t += rnd.choice([0, 1, 2, 5, 30, 200, 301, 900])
            rows.append((k, t))
    df = spark.createDataFrame(rows, "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = alerts.cooldown(df, "k", "ts", seconds=300, chunk_buckets=4)
    res = {}
    for r in got.collect():
        res.setdefault(r["k"], []).append(r["t"])
    for k in ("hot", "a", "b"):
        exp = _greedy([t for kk, t in rows if kk == k], 300)
        assert sorted(res[k]) == exp


@pytest.mark.parametrize("seconds,buckets", [(300, 1), (300, 7), (5_000, 1), (7, 3)])
def test_cooldown_of_large_keys_through_the_tree(spark, seconds, buckets, monkeypatch):
    monkeypatch.setattr(alerts, "FAN", 3)  # several levels
    rnd = random.Random(seconds)
    rows = []
    for k in ("hot", None, "few"):
        t = -20_000 if k == "hot" else 1_700_000_000
        for _ in range(3000 if k != "few" else 20):
            t += rnd.choice([0, 1, 1, 3, 30, 299, 300, 301, 4_999, 20_000] if rnd.random() < 0.2 else [1, 2])
            rows.append((k, t))
    df = spark.createDataFrame([*rows, ("hot", None)], "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    res = {}
    for r in alerts.cooldown(df, "k", "ts", seconds=seconds, chunk_buckets=buckets, single_rows=50).collect():
        res.setdefault(r["k"], []).append(r["t"])
    assert res.keys() == {"hot", None, "few"}
    for k in res:
        assert sorted(res[k]) == _greedy([t for kk, t in rows if kk == k], seconds)


def test_cooldown_of_ten_years_is_many_tasks_and_odd_rows(spark):
    day = 86_400
    df = spark.range(0, 3650 * 20).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 4_320 + F.pmod(F.xxhash64("id"), F.lit(4_000))).alias("ts"))
    got = sorted(r["t"] for r in alerts.cooldown(df, "k", "ts", seconds=day).collect())
    assert got == _greedy([r[0] for r in df.select(F.unix_seconds("ts")).collect()], day)
    assert alerts.cooldown(df.limit(0), "k", "ts").collect() == []


def test_drift_score_null_is_in_range_and_thresholds(spark):
    df = spark.createDataFrame([(0.5, None), (2.0, 0.5), (-1.0, 3.0)], "a double, b double")
    s = df.select(drift.score_expr(["a", "b"], {"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0}).alias("s")).collect()
    assert [r.s for r in s] == [0.0, 0.5, 1.0]

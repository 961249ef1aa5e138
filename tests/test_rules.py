"""Rule tests on small hand-made frames, checked against plain Python."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from flowguard.operators import clean, review, sampling


def _largest_remainder(sizes: dict, n: int) -> dict:
    total = sum(sizes.values())
    if n >= total:
        return dict(sizes)
    exact = {k: Fraction(v * n, total) for k, v in sizes.items()}
    base = {k: int(e) for k, e in exact.items()}
    left = n - sum(base.values())
    order = sorted(sizes, key=lambda k: (-(exact[k] - base[k]), k))
    for k in order[:left]:
        base[k] += 1
    return base


def test_stratum_quotas_and_sample_sizes(spark):
    rnd = random.Random(5)
    rows = [(f"id{i}", rnd.choice(["a", "b", "b", "c", "c", "c", "d"])) for i in range(997)]
    df = spark.createDataFrame(rows, "sid string, s string")
    sizes = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    for n in (1, 10, 250, 996, 2000):
        q = {r["s"]: r["quota"] for r in sampling.stratum_quotas(df, "s", n).collect()}
        assert q == _largest_remainder(sizes, n)
        got = sampling.stratified_sample(df, "sid", "s", n, seed=42)
        assert got.count() == min(n, len(rows))
        assert {r["s"]: r["c"] for r in got.groupBy("s").agg(F.count("*").alias("c")).collect()} == {k: v for k, v in q.items() if v > 0}


def test_split_is_deterministic_and_stratified(spark):
    rows = [(f"id{i}", "x" if i % 4 else "y") for i in range(400)]
    df = spark.createDataFrame(rows, "sid string, s string")
    a = {r["sid"]: r["split"] for r in sampling.stratified_split(df, "sid", "s").collect()}
    b = {r["sid"]: r["split"] for r in sampling.stratified_split(df.repartition(7), "sid", "s").collect()}
    assert a == b
    for s, n in (("x", 300), ("y", 100)):
        ids = [sid for sid, st in rows if st == s]
        assert sum(1 for i in ids if a[i] == "test") == round(n * 0.15)


def test_label_verdicts(spark):
    queue = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "sample_id string")
    validated = spark.createDataFrame([("s2",), (None,)], "sample_id string")
    classes = spark.createDataFrame([("normal",), ("a_f",)], "label string")
    subs = spark.createDataFrame(
        [(1, "s1", "  Normal "), (2, "s1", "normal"), (3, "s2", "normal"), (4, "x9", "normal"), (5, "s3", "bogus"), (6, "s4", "A_F")],
        "submit_seq long, sample_id string, validated_label string")
    v = {r["submit_seq"]: (r["verdict"], r["label"]) for r in review.apply_labels(subs, queue, validated, classes).collect()}
    assert v[1] == ("approved", "normal")
    assert v[2][0] == "already_validated"  # repeat of s1: the first one wins
    assert v[3][0] == "already_validated"
    assert v[4][0] == "unknown_id"
    assert v[5] == ("unknown_label", None)
    assert v[6] == ("approved", "a_f")


def test_archive_is_null_safe(spark):
    validated = spark.createDataFrame([("s1", 1), (None, 2), (None, 3), ("s4", 4)], "sample_id string, seq long")
    processed = spark.createDataFrame([("s1",), (None,)], "sample_id string")
    left = sorted(r["seq"] for r in review.archive(validated, processed).collect())
    assert left == [4]  # a processed record without id removes every id-less row


def test_typed_parse_kinds(spark):
    df = spark.createDataFrame([(" 12 ",), ("1.5",), ("TRUE",), ("",), (None,), ("abc",), ("1e3",), ("nan",)], "c string")
    kinds = [r[0] for r in df.select(clean.typed_parse("c")[0]).collect()]
    assert kinds == ["int", "float", "bool", "null", "null", "string", "int", "float"]


def test_resets_empty_the_drift_window(spark):
    from flowguard.operators import drift as dr

    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "t int, score double")
    got = dr.rolling(dr.reset_epochs(rows, "t", [40, 15]), ["t"], partition_by=["epoch"], size=10).collect()
    for r in got:
        start = max([0] + [x for x in (15, 40) if x <= r["t"]])
        seen = [float(i % 7) for i in range(max(start, r["t"] - 9), r["t"] + 1)]
        assert r["window_observations"] == len(seen) and abs(r["rolling_score"] - sum(seen) / len(seen)) < 1e-12
    assert dr.disabled_status(spark, "/none").first()["enabled"] is False


def test_reset_of_alert_state(spark):
    import datetime as dt

    from flowguard.operators import alerts as al

    at = dt.datetime(2024, 1, 1)
    acts = spark.createDataFrame([(1, "a", at, "trigger"), (2, "b", at + dt.timedelta(hours=2), "trigger"), (3, "c", at + dt.timedelta(hours=3), "resolve")],
                                 "seq int, key string, ts timestamp, action string").selectExpr("*", "'x' as category", "'w' as severity")
    sent = spark.createDataFrame([], "key string, t long")
    assert {r["key"] for r in al.active_alerts(acts, sent).collect()} == {"a", "b"}
    assert {r["key"] for r in al.active_alerts(acts, sent, reset_at=at + dt.timedelta(hours=1)).collect()} == {"b"}


def test_cuts_found_in_several_steps_are_those_of_a_sort(spark, monkeypatch):
    monkeypatch.setattr(sampling, "NEAR_CUT", 2)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    df = spark.createDataFrame([(f"k{i}", None if i % 5 == 0 else "ab"[i % 2]) for i in range(3000)], "sid string, s string")
    ranks = spark.createDataFrame([("a", "x", 1), ("a", "y", 700), ("a", "z", 700), ("b", "x", 1200), (None, "x", 600)], "s string, cut string, rank long")
    ends = sampling.cut_points(df, "sid", "s", ranks.withColumnRenamed("s", "stratum"), 42)
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan  # ranked once, not again by each reader
    order = {}
    for r in df.select("s", sampling.hash_order("sid", 42).alias("h"), "sid").collect():
        order.setdefault(r["s"], []).append((r["h"], r["sid"]))
    want = {(r["s"], r["cut"]): sorted(order[r["s"]])[r["rank"] - 1] for r in ranks.collect()}
    assert {(r["stratum"], r["cut"]): (r["_h"], r["_key"]) for r in ends.collect()} == want

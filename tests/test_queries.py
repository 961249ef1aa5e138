"""Query-level checks at sf 0.001: streaming parity with batch, invariants of
splits, evaluation and queues, and the driver entry."""

import pytest
from pyspark.sql import functions as F

from flowguard.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def qs():
    return catalog.all_queries()


def test_alert_stream_matches_batch_keyed_windows(spark, qs):
    a = qs["alert_stream"].fn(spark, SF)
    b = qs["error_rate_window_keyed"].fn(spark, SF)
    j = a.alias("a").join(b.alias("b"), "seq")
    assert a.count() == b.count() == j.count()
    bad = j.filter((F.col("a.window_n") != F.col("b.window_n")) | (F.col("a.errors") != F.col("b.errors"))
                   | ~F.col("a.p95_latency").eqNullSafe(F.col("b.p95_latency")))
    assert bad.count() == 0


def test_drift_stream_matches_batch_keyed_rolling(spark, qs):
    a = qs["drift_stream"].fn(spark, SF)
    b = qs["rolling_drift_keyed"].fn(spark, SF)
    j = a.alias("a").join(b.alias("b"), "sample_id")
    assert a.count() == b.count() == j.count()
    assert j.filter((F.col("a.pos") != F.col("b.pos")) | (F.abs(F.col("a.rolling_score") - F.col("b.rolling_score")) > 1e-12)).count() == 0


def test_split_sizes_add_up(spark, qs):
    d = {r["split"]: r["n_rows"] for r in qs["export_summary"].fn(spark, SF).collect()}
    total = sum(d.values())
    assert abs(d["test"] - 0.15 * total) <= 2 and abs(d["val"] - 0.15 * total) <= 2


def test_macro_f1_in_unit_interval_and_auc_symmetry(spark, qs):
    for r in qs["macro_weighted"].fn(spark, SF).collect():
        assert 0.0 <= r["f1_macro"] <= 1.0
    from flowguard.operators import evaluation as ev
    from flowguard.sources import fixtures

    p = fixtures.preds(spark, SF)
    a = {(r["model"], r["split"]): r["auc"] for r in ev.auc_exact(p, ["model", "split"], "true_bin", "score").collect()}
    b = {(r["model"], r["split"]): r["auc"] for r in ev.auc_exact(p.withColumn("score", -F.col("score")), ["model", "split"], "true_bin", "score").collect()}
    for k in a:
        assert a[k] == pytest.approx(1.0 - b[k], abs=1e-12)


def test_cooldown_sends_are_spaced(spark, qs):
    rows = qs["alert_cooldown"].fn(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source_id"], []).append(r["t"])
    for ts in by.values():
        ts.sort()
        assert all(b - a >= 86_400 for a, b in zip(ts, ts[1:]))


def test_pending_plus_validated_covers_queue(spark, qs):
    from flowguard.operators import review as rv
    from flowguard.sources import fixtures

    q, v = fixtures.review_queue(spark, SF), fixtures.validated(spark, SF)
    pending = rv.pending_count(q, v).first()["pending"]
    validated_in_queue = q.join(v.select("sample_id"), "sample_id", "left_semi").count()
    assert pending + validated_in_queue == q.count()


def test_entry_runs(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["enabled"] is True
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rate_stream_windows_equal_batch(spark, qs):
    s = {(r["window_start"], r["endpoint"]): r["n"] for r in qs["request_rate_stream"].fn(spark, SF).collect()}
    b = {(r["window_start"], r["endpoint"]): r["n"] for r in qs["request_rate"].fn(spark, SF).collect()}
    assert s == b


def test_rate_stream_counts_every_request_whatever_the_files(spark):
    from flowguard.sources import fixtures
    from flowguard.streaming import alert_stream as ast

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, in no order of time
    try:
        requests = fixtures.requests(spark, SF)
        got = ast.rate_stream(spark, requests, files_per_trigger=1).agg(F.sum("n")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == requests.filter("endpoint not in ('/metrics', '/health')").count()


def test_streaming_window_rules():
    import numpy as np

    from flowguard.streaming import alert_stream as ast

    r = np.random.default_rng(4)
    for n, first, size in ((1, 0, 5), (30, 0, 5), (30, 4, 5), (30, 2, 50), (200, 49, 50)):
        d = r.random(n)
        want = []
        for i in range(first, n):
            s = sorted(d[max(0, i - size + 1): i + 1])
            want.append(s[round((len(s) - 1) * 0.95)])
        assert ast.trailing_p95(d, first, size).tolist() == want
    fires, seconds = r.random(500) < 0.3, np.sort(r.integers(0, 3000, 500))
    for last in (None, 100):
        want, at = [], last
        for f, t in zip(fires, seconds):
            want.append(bool(f and (at is None or t - at >= 300)))
            at = int(t) if want[-1] else at
        sent, end = ast.cooled(fires, seconds, last, 300)
        assert sent.tolist() == want and end == at


def test_drift_stream_orders_chunks_of_one_key():
    import numpy as np
    import pandas as pd

    from flowguard.streaming.drift_stream import _monitor

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

    r = np.random.default_rng(5)
    rows = pd.DataFrame({"ts": range(25_000), "sample_id": [f"s{i:05d}" for i in range(25_000)], "score": r.random(25_000)})
    mixed, state, out = rows.sample(frac=1, random_state=1), State(), []
    for part in (mixed[mixed.ts < 15_000], mixed[mixed.ts >= 15_000]):  # two micro-batches, each in several chunks
        out += list(_monitor(100)(("k",), iter([part.iloc[i: i + 4000] for i in range(0, len(part), 4000)]), state))
    got = pd.concat(out)
    assert got["sample_id"].tolist() == rows["sample_id"].tolist() and got["pos"].tolist() == list(range(25_000))
    assert np.allclose(got["rolling_score"], rows["score"].rolling(100, min_periods=1).mean(), rtol=0, atol=1e-11)


def test_streams_cut_a_hot_key_into_blocks_and_carry_over_batches(spark, tmp_path):
    import numpy as np
    import pandas as pd

    from flowguard.streaming import alert_stream as ast
    from flowguard.streaming import drift_stream as ds

    r, n = np.random.default_rng(6), 3000
    second = 1_700_000_000 + np.cumsum(r.integers(0, 4, n)) - np.where(r.random(n) < 0.05, 20, 0)  # some out of order
    rows = pd.DataFrame({"seq": range(n), "source_id": np.where(r.random(n) < 0.7, 1, 2), "endpoint": "/x", "http_status": np.where(r.random(n) < 0.3, 500, 200),
                         "duration": r.random(n) * 3.2, "second": second})
    rows["service"], rows["sample_id"], rows["ts"], rows["score"] = rows.source_id.astype(str), rows.seq.astype(str), rows.seq, rows.duration
    alerts, drift = (str(tmp_path / x) for x in ("alerts", "drift"))
    write_alerts, write_drift = ast.batch_writer(alerts, alerts + "-ckpt", 50, block=100), ds.batch_writer(drift, drift + "-ckpt", 20, block=100)
    for number, part in enumerate((rows[:1200], rows[1200:1210], rows[1210:])):
        batch = spark.createDataFrame(part.sample(frac=1, random_state=1))
        for write in (write_alerts, write_alerts, write_drift, write_drift):  # a repeated micro-batch changes nothing
            write(batch, number)
    read = lambda path: spark.read.option("recursiveFileLookup", "true").parquet(path).toPandas()
    got, rolled = read(alerts).sort_values("seq"), read(drift)
    assert len(got) == len(rolled) == n
    for source, one in rows.groupby("source_id"):
        mine, roll = got[got.source_id == source], rolled[rolled.service == str(source)].sort_values("pos")
        assert roll.pos.tolist() == list(range(len(one))) and roll.sample_id.tolist() == one.sample_id.tolist()
        assert np.allclose(roll.rolling_score, one.score.rolling(20, min_periods=1).mean(), rtol=0, atol=1e-11)
        assert mine.errors.tolist() == (one.http_status >= 400).rolling(50, min_periods=1).sum().astype(int).tolist()
        assert np.array_equal(mine.p95_latency.to_numpy()[9:], ast.trailing_p95(one.duration.to_numpy(), 0, 50)[9:])
        for f in ast.FLAGS:
            sent = ast.cooled(mine[f"{f}_alert"].to_numpy(), one.second.to_numpy(), None, 50)[0]
            assert mine[f"{f}_sent"].tolist() == sent.tolist() and 5 < sent.sum() < mine[f"{f}_alert"].sum()


def test_retraining_registers_activates_and_reports_failures(spark):
    from flowguard.operators import retrain
    from flowguard.session import scratch_path

    base = scratch_path(spark, "retrain-test")
    train = spark.createDataFrame([("a" if i % 2 else "b", float(i % 2), float(i)) for i in range(80)], "class1 string, x double, duration double")
    ok = spark.createDataFrame([(f"s{i}", "approved", "a" if i % 2 else "b", float(i)) for i in range(60)],
                               "sample_id string, review_status string, validated_label string, duration double")
    args = (train, train, ["x", "duration"])
    skipped = retrain.run(spark, *args, ok.limit(10), "RF_v1", base, "decision_tree").first()
    assert (skipped["status"], skipped["version"], skipped["approved"]) == ("skipped", None, 10)
    assert retrain.active_version(spark, base) is None and retrain.registry(spark, base).count() == 0
    first = retrain.run(spark, *args, ok, "RF_v1", base, "decision_tree").first()
    assert (first["status"], first["merged_rows"], first["archived"], first["remaining"]) == ("success", 140, 60, 0)
    again = retrain.run(spark, *args, ok, "RF_v1", base, "decision_tree").first()  # the version's folders exist
    assert (again["status"], again["previous_version"]) == ("failed", "RF_v1")
    second = retrain.run(spark, *args, ok, "RF_v2", base, "decision_tree").first()
    assert (second["status"], second["previous_version"]) == ("success", "RF_v1")
    assert retrain.active_version(spark, base) == "RF_v2"
    assert [r["status"] for r in retrain.audit(spark, base).orderBy("seq").collect()] == ["skipped", "success", "failed", "success"]
    assert sorted(r["version"] for r in retrain.registry(spark, base).collect()) == ["RF_v1", "RF_v2"]

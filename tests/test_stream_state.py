"""Resets, resolved and active alerts on the streams against a plain scan, over micro-batches that are repeated."""

import numpy as np
import pandas as pd
import pytest

from flowguard.operators import alerts as al
from flowguard.streaming import alert_stream as ast
from flowguard.streaming import drift_stream as ds

N, COOLDOWN = 1500, 40


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    out = pd.DataFrame({"seq": range(N), "source_id": np.where(r.random(N) < 0.7, 1, r.integers(2, 6, N)), "endpoint": "/x", "http_status": np.where(r.random(N) < 0.31, 500, 200),
                        "duration": r.random(N) * 3.15, "second": 1_700_000_000 + np.cumsum(r.integers(0, 4, N))})
    out.loc[[300, 301, 905], "endpoint"] = ast.RESET_ENDPOINT
    return out


def _plain(rows):
    """One request after the other: windows by source, sends and active alerts by key, both cleared by a reset."""
    windows, last, active, out = {}, {}, {}, {}
    for r in rows.itertuples():
        if r.endpoint == ast.RESET_ENDPOINT:
            last, active = {}, {}
            continue
        w = windows.setdefault(r.source_id, [])
        w.append((r.http_status >= 400, r.duration))
        del w[: -al.REQUEST_WINDOW]
        if len(w) < al.REQUEST_MIN_WINDOW:
            continue
        durations = sorted(d for _, d in w)
        fires = {"error_rate": np.mean([e for e, _ in w]) >= 0.30, "latency": durations[round((len(w) - 1) * 0.95)] >= 3.0}
        for f, fire in fires.items():
            key = f, r.source_id
            sent = bool(fire and (key not in last or r.second - last[key] >= COOLDOWN))
            if sent:
                last[key] = r.second
            if fire:
                active[key] = (r.seq, not sent)
            else:
                active.pop(key, None)
            out[r.seq, f] = sent
    return active, out


@pytest.mark.parametrize("cuts", [(0, N), (0, 250, 301, 310, 900, N), (0, 1000, 1003, 1400)])
def test_alert_state_over_resets(spark, tmp_path, rows, cuts):
    sink = str(tmp_path / "out")
    write = ast.batch_writer(sink, sink + "-state", COOLDOWN, block=100)
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(rows[a:b].sample(frac=1, random_state=1))
        write(batch, number)
        if number == 1:
            write(batch, number)  # a repeated micro-batch changes nothing
    active, sent = _plain(rows[: cuts[-1]])
    got = {(r.alert, r.source_id): (r.seq, r.cooldown_active) for r in ast.active_alerts(spark, sink + "-state").collect()}
    assert got == active and len(active) >= 1
    out = spark.read.option("recursiveFileLookup", "true").parquet(sink).toPandas().set_index("seq")
    assert len(out) == (rows[: cuts[-1]].endpoint == "/x").sum()
    assert all(out.loc[seq, f"{f}_sent"] == v for (seq, f), v in sent.items())


def test_no_alerts_before_the_first_micro_batch(spark, tmp_path):
    assert ast.active_alerts(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("cuts", [(0, 600), (0, 100, 205, 206, 600)])
def test_drift_window_over_resets(spark, tmp_path, cuts):
    r = np.random.default_rng(9)
    rows = pd.DataFrame({"service": np.where(r.random(600) < 0.8, "a", "b"), "sample_id": [f"s{i:04d}" for i in range(600)], "ts": range(600), "score": r.random(600), "reset": False})
    rows.loc[[200, 205, 420], "reset"] = True
    sink = str(tmp_path / "out")
    write = ds.batch_writer(sink, sink + "-state", 20, block=50)
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(rows[a:b].sample(frac=1, random_state=1))
        write(batch, number)
        write(batch, number)
    got = spark.read.option("recursiveFileLookup", "true").parquet(sink).toPandas().set_index("sample_id")
    rows["epoch"] = rows["reset"].cumsum()
    samples = rows[~rows["reset"]]
    assert len(got) == len(samples)
    for _, one in samples.groupby(["service", "epoch"]):
        mine = got.loc[one.sample_id]
        assert mine.pos.tolist() == list(range(len(one))) and mine.window_observations.tolist() == [min(i + 1, 20) for i in range(len(one))]
        assert np.allclose(mine.rolling_score, one.score.rolling(20, min_periods=1).mean(), rtol=0, atol=1e-11)

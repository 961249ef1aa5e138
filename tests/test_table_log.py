"""Numbered commits: two writers, whole writes, earlier states, and the audit
of model selections made from them."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from flowguard.operators import registry as rg
from flowguard.session import scratch_path
from flowguard.sources import table_log

SCHEMA = "a long"


def _rows(df):
    return sorted(r["a"] for r in df.collect())


def _frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], SCHEMA)


def test_states_of_a_table(spark):
    base = scratch_path(spark, "log")
    assert table_log.version(spark, base) == 0 and _rows(table_log.read(spark, base, SCHEMA)) == []
    assert table_log.append(_frame(spark, 1, 2), base) == 1
    assert table_log.append(_frame(spark), base) == 2
    assert table_log.replace(_frame(spark, 2), base, expected=2) == 3
    assert table_log.append(_frame(spark, 5), base) == 4
    assert _rows(table_log.read(spark, base, SCHEMA)) == [2, 5]
    assert _rows(table_log.read(spark, base, SCHEMA, at=2)) == [1, 2]
    assert sorted(map(tuple, table_log.read(spark, base, SCHEMA, number_out="n").collect())) == [(2, 3), (5, 4)]
    with pytest.raises(table_log.Conflict):
        table_log.replace(_frame(spark, 9), base, expected=2)
    assert _rows(table_log.read(spark, base, SCHEMA)) == [2, 5]


@pytest.mark.parametrize("scheme", ["link", "rename"])
def test_a_number_is_taken_once(spark, scheme, monkeypatch):
    base = scratch_path(spark, "log")
    if scheme == "rename":
        def rename(source, target):
            table_log._rename(spark, *(spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)))
        monkeypatch.setattr(table_log.os, "link", rename)
    assert table_log.claim(spark, base, 1, "add", "x")
    assert not table_log.claim(spark, base, 1, "add", "y")
    assert [e["folder"] for e in table_log.entries(spark, base)] == ["x"]


def test_two_writers(spark):
    base = scratch_path(spark, "log")
    with ThreadPoolExecutor(4) as pool:
        taken = list(pool.map(lambda v: table_log.append(_frame(spark, v).coalesce(1), base), range(12)))
    assert sorted(taken) == list(range(1, 13))
    assert _rows(table_log.read(spark, base, SCHEMA)) == list(range(12))
    with ThreadPoolExecutor(4) as pool:
        claims = list(pool.map(lambda i: table_log.claim(spark, base, 13, "add", f"w{i}"), range(8)))
    assert claims.count(True) == 1


def _registry(spark):
    return spark.createDataFrame([("RF_v1", 0.9), ("RF_v2", 0.8)], "version string, f1_macro double")


def test_selections_equal_a_sequential_scan(spark):
    base = scratch_path(spark, "audit")
    asked = [(i, [f"RF_v{1 + i * 7 % 5}", None][i % 11 == 3]) for i in range(300)]
    frame = spark.createDataFrame(asked, "seq long, version string").repartition(6)
    rg.select_versions(frame.where("seq < 120"), _registry(spark), base)
    rg.record(spark, base, "RF_v1", None, "skipped", "too few labels")
    rg.select_versions(frame.where("seq >= 120"), _registry(spark), base)
    want, active = [], None
    for i, v in asked:
        ok = v in ("RF_v1", "RF_v2")
        want.append((i, active, v, "success" if ok else "failed"))
        active = v if ok else active
    got = rg.audit(spark, base).where("status <> 'skipped'").select("seq", "previous_model", "new_model", "status")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert rg.active_version(rg.audit(spark, base)).first()[0] == active
    assert [r["new_model"] for r in rg.history(rg.audit(spark, base), 3).collect()] == [v for _, v in asked[:-4:-1]]
    flags = {r["version"]: r["active"] for r in rg.active_flags(_registry(spark), rg.audit(spark, base)).collect()}
    assert flags == {v: int(v == active) for v in ("RF_v1", "RF_v2")}


def test_selection_is_made_again_after_a_conflict(spark, monkeypatch):
    base = scratch_path(spark, "audit")
    right, calls = table_log.append, []

    def late(df, where, expected=None, fmt="json"):
        if not calls:  # another writer activates RF_v2 in between
            calls.append(1)
            right(spark.createDataFrame([(None, None, "RF_v2", "success", None)], rg.AUDIT), where)
        return right(df, where, expected, fmt)

    monkeypatch.setattr(table_log, "append", late)
    rg.select_versions(spark.createDataFrame([(1, "RF_v1")], "seq long, version string"), _registry(spark), base)
    last = rg.audit(spark, base).orderBy(F.col("commit").desc()).first()
    assert (last["commit"], last["previous_model"], last["new_model"]) == (2, "RF_v2", "RF_v1")


def test_no_requests_and_no_active_version(spark):
    base = scratch_path(spark, "audit")
    rg.select_versions(spark.createDataFrame([], "seq long, version string"), _registry(spark), base)
    assert rg.audit(spark, base).count() == 0
    assert {r["active"] for r in rg.active_flags(_registry(spark), rg.audit(spark, base)).collect()} == {0}

"""Late rows of a stream: closed, open and late against a plain scan of the micro-batches, restart, repeated micro-batch."""

import datetime as dt
import json
import os

import pytest

from flowguard.session import scratch_path
from flowguard.streaming import late_rows as lr

DELAY, T0 = 120, 1_700_000_000 // 60 * 60
SCHEMA = "seq long, endpoint string, ts timestamp"


def _row(seq, endpoint, at):
    return {"seq": seq, "endpoint": endpoint, "ts": None if at is None else dt.datetime.fromtimestamp(T0 + at, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")}


BATCHES = [
    [(1, "a", 0), (2, "a", 59.5), (3, "b", 61), (4, None, 3)],
    [(5, "a", 30), (6, "a", 239.999)],  # 5 is in time: nothing above 61 was seen
    [(7, "a", 10), (8, "b", 60), (9, "a", 500), (10, "a", None)],  # watermark 119.999: 7 is late, 8 is not
    [(11, "b", 120), (12, "b", 379), (13, "a", 380), (14, "a", 20), (14, "a", 20)],  # watermark 380: the window from 120 on is closed, that from 360 on is open
]


def _plain():
    highest, open_, closed, late = None, {}, {}, []
    for rows in BATCHES:
        mark = None if highest is None else highest - DELAY
        for seq, endpoint, at in rows:
            start = None if at is None else int(at // 60) * 60
            if at is not None and mark is not None and start + 60 <= mark:
                late.append(seq)
            else:
                open_[start, endpoint] = open_.get((start, endpoint), 0) + 1
        highest = max([v for *_, v in rows if v is not None] + ([highest] if highest is not None else []))
        for key in [k for k in open_ if k[0] is not None and k[0] + 60 <= highest - DELAY]:
            assert key not in closed  # a window is final once
            closed[key] = open_.pop(key)
    return closed, open_, late


def _stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src)


def _write(src, number):
    src.mkdir(exist_ok=True)
    path = src / f"part-{number}.json"
    path.write_text("\n".join(json.dumps(_row(*r)) for r in BATCHES[number]))
    os.utime(path, (T0 + number * 10, T0 + number * 10))


def _found(rates):
    of = lambda df: {(None if r.window_start is None else r.window_start - T0, r.endpoint): r.n for r in df.collect()}
    return of(rates.closed), of(rates.open), sorted(r.seq for r in rates.late.collect())


@pytest.mark.parametrize("restart", [False, True])
def test_closed_open_and_late_rows(spark, tmp_path, restart):
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    for number in range(len(BATCHES)):
        _write(tmp_path / "in", number)
        if restart:
            rates = lr.run(_stream(spark, str(tmp_path / "in")), sink, ckpt, DELAY)
    if not restart:
        rates = lr.run(_stream(spark, str(tmp_path / "in")), sink, ckpt, DELAY)
    closed, open_, late = _plain()
    assert late == [7, 11, 14, 14] and _found(rates) == (closed, open_, late)
    counted = rates.counted().collect()
    assert sum(r.on_time + r.late for r in counted) == sum(len(b) for b in BATCHES)
    assert sum(r.late for r in counted) == 4


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    write = lr.batch_writer(sink, ckpt, DELAY)
    for number, rows in enumerate(BATCHES):
        made = spark.createDataFrame([(s, e, None if at is None else dt.datetime.fromtimestamp(T0 + at, dt.UTC)) for s, e, at in rows], SCHEMA)
        write(made, number)
        write(made, number)
    closed, open_, late = _plain()
    nested = lambda schema, path: spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(path)
    rates = lr.Rates(nested(lr.COUNTS, f"{sink}/closed"), spark.read.parquet(f"{ckpt}/open/batch-3"), nested(f"{SCHEMA}, window_start long", f"{sink}/late"))
    assert _found(rates) == (closed, open_, late)


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rates = lr.run(_stream(spark, str(tmp_path / "in")), scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt"), DELAY)
    assert rates.counted().collect() == []

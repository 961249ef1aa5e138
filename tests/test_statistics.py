"""Column statistics against numpy: one scan for any number of columns, exact
quantiles by bracketing."""

import numpy as np
import pytest

from flowguard.operators import features, stats


def _frame(spark, table: np.ndarray):
    names = [f"c{i}" for i in range(table.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in table]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5), names


def _scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 40)) + rng.normal(size=(400, 1)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 3.25
    x[:, 8] = np.nan
    return x


def _pearson(a, b):
    both = ~np.isnan(a) & ~np.isnan(b)
    a, b = a[both], b[both]
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return None
    return abs(np.corrcoef(a, b)[0, 1])


def test_moments_of_many_columns(spark, table):
    df, names = _frame(spark, table)
    got = {r["feature"]: r for r in features.variance_table(df, names).collect()}
    assert set(got) == set(names)
    for i, c in enumerate(names):
        v = table[~np.isnan(table[:, i]), i]
        assert got[c]["n"] == len(v)
        if len(v):
            assert got[c]["variance"] == pytest.approx(v.var(ddof=1), rel=1e-9, abs=1e-12)
            assert (got[c]["min_value"], got[c]["max_value"]) == (v.min(), v.max())
    assert got["c8"]["mean"] is None


def test_correlations_of_many_columns(spark, table):
    df, names = _frame(spark, table)
    pairs = features.pairwise_correlation(df, names).collect()
    assert len(pairs) == 40 * 39 // 2
    for r in pairs:
        want = _pearson(table[:, r["i"]], table[:, r["j"]])
        assert (r["abs_corr"] is None) if want is None else r["abs_corr"] == pytest.approx(want, abs=1e-9)
    target = features.target_correlation(df, names[1:], df["c0"]).collect()
    for r in target:
        want = _pearson(table[:, int(r["feature"][1:])], table[:, 0])
        assert (r["abs_corr"] is None) if want is None else r["abs_corr"] == pytest.approx(want, abs=1e-9)


def test_one_scan_whatever_the_columns(spark, table):
    df, names = _frame(spark, table)
    centres = dict.fromkeys(names, 1e6)
    for made in (features.variance_table(df, names), features.target_correlation(df, names, df["c0"]), features.pairwise_correlation(df, names, centres)):
        base = 1  # the table of names or pairs is a local one
        assert _scans(made) <= base + 1


def test_infinite_and_nan_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 4.5, 1.0), (float("nan"), 9.0, 2.0), (3.0, 5.0, 3.0)], "a double, b double, w double")
    got = {(r["feature_i"], r["feature_j"]): r["abs_corr"] for r in features.pairwise_correlation(df, ["a", "b", "w"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1])
    assert got["a", "w"] is None and got["b", "w"] is None
    t = {r["feature"]: r["abs_corr"] for r in features.target_correlation(df, ["a", "w"], df["b"]).collect()}
    assert t["a"] == pytest.approx(got["a", "b"]) and t["w"] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [(r["n"], r["variance"]) for r in features.variance_table(df, ["a", "b"]).collect()] == [(0, None)] * 2
    assert [r["abs_corr"] for r in features.pairwise_correlation(df, ["a", "b"]).collect()] == [None]
    assert [r["n"] for r in stats.quantiles(df, ["a", "b"], [0.5]).collect()] == [0, 0]


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def _skewed(rng):
    return np.column_stack([
        np.where(rng.random(6000) < 0.7, 0.0, rng.lognormal(0, 8, 6000)),  # a value that holds most rows
        rng.integers(0, 3, 6000).astype(float),
        rng.normal(size=6000),
    ])


def test_quantiles_with_hot_values(spark):
    x = _skewed(np.random.default_rng(5))
    df, names = _frame(spark, x)
    got = {r["feature"]: r for r in stats.quantiles(df, names, PROBS).collect()}
    for i, c in enumerate(names):
        assert got[c]["n"] == 6000
        for k, p in enumerate(PROBS):
            assert got[c][f"q_{k}"] == pytest.approx(np.quantile(x[:, i], p), rel=1e-12)


def test_quantiles_when_every_bracket_misses(spark, monkeypatch):
    x = _skewed(np.random.default_rng(6))
    df, names = _frame(spark, x)
    right = stats.sketch
    monkeypatch.setattr(stats, "sketch", lambda rows, probs: {f: (n, [(1e300, 1e301)] * len(b)) for f, (n, b) in right(rows, probs).items()})
    got = {r["feature"]: r for r in stats.quantiles(df, names, PROBS).collect()}
    for i, c in enumerate(names):
        for k, p in enumerate(PROBS):
            assert got[c][f"q_{k}"] == pytest.approx(np.quantile(x[:, i], p), rel=1e-12)


def test_few_rows_reach_the_shuffle(spark):
    x = np.random.default_rng(7).normal(size=(30000, 1))
    df, names = _frame(spark, x)
    rows = stats._long(df, names)
    assert stats._counts(rows, stats.sketch(rows, [0.5])).count() < 300

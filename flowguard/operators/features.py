"""Feature statistics and selection (F1–F13). Each selection step returns a
decision table ``(feature, value, threshold, decision, reason)``; only that
table (one row per column or pair) reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import safe_div

# Selection thresholds.
RELEVANCE_MIN = 0.025
REDUNDANCY_MAX = 0.97
PCA_VARIANCE = 0.95
PCA_TOP = 20


def _values(df: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """``(_i, _x)``: each value of each row with its column's place; nulls included."""
    wide = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    return df.select(F.posexplode(wide).alias("_i", "_x"), *keep)


def _per_column(columns: Sequence[str], table: DataFrame) -> DataFrame:
    """``table`` (one row per column place) with a row for every column."""
    names = table.sparkSession.createDataFrame(list(enumerate(columns)), "_i int, feature string")
    return names.join(F.broadcast(table), "_i", "left")


# F1 / F2 ---------------------------------------------------------------------
def variance_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample variance, non-null count, min, max and mean of every column,
    from one scan for any number of columns: values are added up by column in
    each task, and one row per task and column is shuffled. The means also
    centre the correlation sums and fill nulls. A column without values (or
    any column of an empty table) has n = 0 and nulls."""
    sums = _values(df, columns).groupBy("_i").agg(
        F.var_samp("_x").alias("variance"), F.count("_x").alias("n"), F.min("_x").alias("min_value"),
        F.max("_x").alias("max_value"), F.avg("_x").alias("mean"))
    return _per_column(columns, sums).select("feature", "variance", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                                             "min_value", "max_value", "mean")


def zero_variance(df: DataFrame, columns: Sequence[str], table: DataFrame | None = None) -> DataFrame:
    """Decision table: drop when at least two values and min = max (variance
    exactly 0 without float noise)."""
    v = table if table is not None else variance_table(df, columns)
    zero = (F.col("n") >= 2) & (F.col("min_value") == F.col("max_value"))
    return v.select(
        "feature",
        F.col("variance").cast("double").alias("variance"),
        F.col("n").cast("long").alias("n"),
        F.when(zero, "drop").otherwise("keep").alias("decision"),
        F.when(zero, "zero_variance").when(F.col("n") == 0, "all_null").otherwise(F.lit(None)).alias("reason"),
    )


# F3 / F4 ---------------------------------------------------------------------
def target_correlation(df: DataFrame, columns: Sequence[str], target: Column, threshold: float = RELEVANCE_MIN) -> DataFrame:
    """|r(column, target)| over rows where both are present (NaN is missing);
    below ``threshold`` → drop; undefined (NULL: fewer than two rows, a
    constant, an infinite value) → keep. One scan for any number of columns."""
    both = _values(df, columns, target.cast("double").alias("_y")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    sums = both.groupBy("_i").agg(F.covar_pop("_x", "_y").alias("cov"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"))
    r = safe_div(F.col("cov"), F.col("sx") * F.col("sy"))
    t = _per_column(columns, sums).select("feature", F.when(~F.isnan(r), F.abs(r)).alias("abs_corr"))
    low = F.coalesce(F.col("abs_corr") < F.lit(threshold), F.lit(False))
    return t.select(
        "feature",
        F.col("abs_corr").cast("double").alias("abs_corr"),
        F.when(low, "drop").otherwise("keep").alias("decision"),
        F.when(low, "low_relevance").when(F.col("abs_corr").isNull(), "undefined").alias("reason"),
    )


# F5 / F6 ---------------------------------------------------------------------
_PAIR = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double, wild double"
_CELLS = 1 << 20  # values that are multiplied at once


def _products(centre: Sequence[float]):
    """A task's sums for all pairs i < j of columns: cross products of the
    centred values and of the masks that say where a value is present."""
    mid = np.array(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(mid)
        n, s, ss, xy, wild = (np.zeros((p, p)) for _ in range(5))
        rows = max(1, _CELLS // p)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(lo, rows).columns])
                present = ~np.isnan(x)
                infinite = np.isinf(x)
                x = np.where(present & ~infinite, x - mid, 0.0)
                m = present.astype(np.float64)
                n += m.T @ m
                s += x.T @ m  # sum of the row's column where the other one is present
                ss += (x * x).T @ m
                xy += x.T @ x
                wild += infinite.astype(np.float64).T @ m
        i, j = np.triu_indices(p, 1)
        columns = [i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], xy[i, j], wild[i, j] + wild[j, i]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _PAIR.split(", ")])

    return run


def pairwise_correlation(df: DataFrame, columns: Sequence[str], centres: dict[str, float] | None = None) -> DataFrame:
    """Long form ``(i, j, feature_i, feature_j, abs_corr, distance)`` for
    i < j in the given order, over rows where both are present (NaN is
    missing); NULL where undefined: fewer than two rows, a constant, an
    infinite value.

    One scan for any number of columns: each task adds up matrices of cross
    products (memory: five times the square of the columns, plus a bounded
    block of rows) and sends one row per pair, added up by pair. Values are
    shifted by ``centres`` (computed by one more scan unless given), which
    only limits cancellation."""
    cols = list(columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, feature_i string, feature_j string, abs_corr double, distance double")
    if centres is None:
        centres = {r["feature"]: r["mean"] for r in variance_table(df, cols).collect()}
    centre = [v if (v := centres.get(c)) is not None and np.isfinite(v) else 0.0 for c in cols]
    wide = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    names = ["n", "sx", "sy", "sxx", "syy", "sxy", "wild"]
    sums = wide.mapInArrow(_products(centre), _PAIR).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cxx, cyy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    defined = (n >= 2) & (F.col("wild") == 0)
    r = F.when(defined, F.when((cxx > 0) & (cyy > 0), F.abs((F.col("sxy") - sx * sy / n) / F.sqrt(cxx * cyy))))
    # every pair has a row, also when there are no rows to add up
    pairs = df.sparkSession.createDataFrame([(i, j, cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))],
                                            "i int, j int, feature_i string, feature_j string")
    t = pairs.join(sums.select("i", "j", r.alias("abs_corr")), ["i", "j"], "left")
    return t.withColumn("distance", F.lit(1.0) - F.col("abs_corr"))


def redundant(corr: DataFrame, columns: Sequence[str], limit: float = REDUNDANCY_MAX) -> DataFrame:
    """Decision per column j: drop if ANY earlier column i has r > limit
    (even if i is itself dropped)."""
    cols = list(columns)
    hits = corr.filter(F.col("abs_corr") > F.lit(limit)).groupBy("j").agg(F.min("i").alias("first_partner"))
    allc = corr.sparkSession.createDataFrame([(j, c) for j, c in enumerate(cols)], "j int, feature string")
    t = allc.join(hits, "j", "left")
    return t.select(
        "feature",
        F.col("j").alias("position"),
        F.col("first_partner").alias("partner_index"),
        F.when(F.col("first_partner").isNotNull(), "drop").otherwise("keep").alias("decision"),
    )


# F9 / F10 --------------------------------------------------------------------
def pcafss_rank(loadings: DataFrame, top: int = PCA_TOP) -> DataFrame:
    """``loadings``: (component, feature_index, feature, loading). Per
    component the ``top`` largest |loading| (ties: larger index first, as an
    ascending argsort read from the end); count per feature; order by count
    desc, then by first appearance (component, then position inside the
    component's top list read from smallest to largest |loading|)."""
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), F.col("feature_index").desc())
    ranked = loadings.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top)
    # position of the feature in the ascending top list: top-rk (0 = smallest kept)
    first_seen = F.min(F.col("component") * F.lit(1_000_000) + (F.least(F.lit(top), F.col("n_in")) - F.col("rk")))
    counts = (
        ranked.withColumn("n_in", F.count(F.lit(1)).over(Window.partitionBy("component")))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("count"), first_seen.alias("first_seen"))
    )
    wr = Window.orderBy(F.col("count").desc(), F.col("first_seen"))
    return counts.select("feature", F.col("count").cast("long").alias("count"), F.row_number().over(wr).alias("rank"))


# F11–F13 ---------------------------------------------------------------------
def class_counts_topk(df: DataFrame, label: str = "class1", k: int = 15) -> DataFrame:
    """Top ``k`` labels by share (ties by name). The window runs over the
    grouped table (one row per label), not over rows."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col(label))
    res = g.select(
        label,
        F.col("n").cast("long").alias("n"),
        (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"),
        F.row_number().over(w).alias("rank"),
    )
    return res.filter(F.col("rank") <= k)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: n / (k · n_c)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return g.select(
        label,
        F.col("n_c").cast("long").alias("n_c"),
        (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"),
    )

"""Exact quantiles of many columns (linear interpolation, the numpy / DuckDB
``quantile_cont`` rule) by bracketing, from two scans and without moving rows.

The first scan builds a mergeable sketch per column, which gives a value just
below and one just above each wanted quantile. The second counts rows by
column: a value between such bounds is counted by itself, everything else by
the gap between bounds in which it lies. Running sums of these counts give
the exact places of the values between the bounds. What is shuffled is one
row per distinct value between bounds (a small share of the rows, and one for
any number of ties), range-partitioned, so no task holds a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .ordering import running_sums

ACCURACY = 1_000  # of the sketch: its places are right within n / ACCURACY

Bracket = tuple[float, float]


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    return df.select(F.posexplode(wide).alias("_f", "_x")).where("_x is not null and not isnan(_x)")


def sketch(rows: DataFrame, probs: Sequence[float]) -> dict[int, tuple[int, list[Bracket]]]:
    """Per column with values: their number and a bracket per probability."""
    margin = 2.0 / ACCURACY
    at = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)]
    found = rows.groupBy("_f").agg(F.count("*").alias("n"), F.percentile_approx("_x", at, ACCURACY).alias("cut")).collect()
    return {r["_f"]: (r["n"], list(zip(r["cut"][::2], r["cut"][1::2]))) for r in found}


def _counts(rows: DataFrame, brackets: dict[int, tuple[int, list[Bracket]]]) -> DataFrame:
    """``(_f, _lo, _hi, _n, _all)``: rows by value inside the brackets and by
    gap outside them, with the least and the largest value of each; written."""
    spark = rows.sparkSession
    k = max(len(b) for _, b in brackets.values())
    schema = "_f int, _all long" + "".join(f", _a{i} double, _b{i} double" for i in range(k))
    bounds = spark.createDataFrame([(f, n, *[v for ab in b for v in ab]) for f, (n, b) in brackets.items()], schema)
    x = F.col("_x")
    inside = reduce(or_, [(x >= F.col(f"_a{i}")) & (x <= F.col(f"_b{i}")) for i in range(k)])
    gap = reduce(lambda a, b: a + b, [(F.col(c) < x).cast("int") for i in range(k) for c in (f"_a{i}", f"_b{i}")])
    keyed = rows.join(F.broadcast(bounds), "_f").select("_f", "_all", "_x", gap.alias("_gap"), F.when(inside, x).alias("_key"))
    counts = keyed.groupBy("_f", "_all", "_gap", "_key").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"))
    path = scratch_path(spark, "quantiles")
    counts.drop("_gap", "_key").write.parquet(path)
    return spark.read.parquet(path)


def _at_ranks(counts: DataFrame, probs: Sequence[float]) -> dict[int, list[tuple[Bracket, Bracket]]]:
    """Per column and probability, the counted values (least, largest) that
    hold the ranks below and above the quantile."""
    upto, whole = F.col("cum__n"), (F.col("_all") - 1).cast("double")
    summed = running_sums(counts, ["_n"], ["_hi"], ["_f"])
    aggs = []
    for i, p in enumerate(probs):
        for name, rank in (("d", F.floor(whole * F.lit(p))), ("u", F.ceil(whole * F.lit(p)))):
            here = (rank < upto) & (rank >= upto - F.col("_n"))
            aggs += [F.max(F.when(here, F.col("_lo"))).alias(f"{name}a{i}"), F.max(F.when(here, F.col("_hi"))).alias(f"{name}b{i}")]
    return {r["_f"]: [((r[f"da{i}"], r[f"db{i}"]), (r[f"ua{i}"], r[f"ub{i}"])) for i in range(len(probs))]
            for r in summed.groupBy("_f").agg(*aggs).collect()}


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], feature: str = "feature") -> DataFrame:
    """One row per column: ``feature``, ``n`` (non-null count) and one
    column ``q_<i>`` per probability (NULL when the column has no values).
    NULLs and NaN are ignored. Runs at the call; only one row per column
    reaches the driver.

    A rank that the sketch's bracket misses lies in a gap whose least and
    largest value are then known: they are its bracket in one more scan."""
    probs = [float(p) for p in probs]
    rows = _long(df, columns)
    brackets = sketch(rows, probs)
    n = {f: b[0] for f, b in brackets.items()}
    exact: dict[int, list[float]] = {}
    while brackets:
        places = _at_ranks(_counts(rows.where(F.col("_f").isin(list(brackets))), brackets), probs)
        missed = {}
        for f, found in places.items():
            gaps = [v for pair in found for v in pair if v[0] != v[1]]
            if gaps:
                missed[f] = (n[f], [b for pair in found for b in pair])
                continue
            share = [(n[f] - 1) * p for p in probs]
            exact[f] = [d[0] + (u[0] - d[0]) * (h - math.floor(h)) if u[0] != d[0] else d[0] for (d, u), h in zip(found, share)]
        brackets = missed
    out = [(c, n.get(f, 0), *exact.get(f, [None] * len(probs))) for f, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(out, f"{feature} string, n long" + "".join(f", q_{i} double" for i in range(len(probs))))

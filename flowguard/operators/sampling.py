"""Splits and samples (P1–P4), deterministic from a seed.

Order inside a stratum is ``md5(key || seed)`` then the key (which is unique),
the same in Spark and DuckDB. A split is a cut of that order at half-even
rounded shares, so no row needs its rank: ``cut_points`` finds the last row on
the near side of each cut from histograms of hash prefixes, which get finer
until few rows are left around a cut, and rows are then compared with the cut.
No row is shuffled or sorted, however many a stratum has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small

DIGITS = 3  # hex digits of the hash that each histogram adds: 4,096 times as fine
NEAR_CUT = 65_536  # rows around a cut that are ranked


def hash_order(key: str, seed: str | int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def cut_points(df: DataFrame, key: str, strata: str | None, ranks: DataFrame, seed: str | int = 42) -> DataFrame:
    """The rows at given places of the strata's hash order. ``ranks`` has
    (stratum, cut, rank), rank from 1 to the stratum's rows; the result adds
    ``_h`` and ``_key`` of the row at that rank.

    The first step counts rows by stratum and hash prefix, later ones by finer
    prefixes below those in which cuts were found (4,096 counts for each), and
    they end when at most ``NEAR_CUT`` rows share a cut's prefix; those are
    ranked. A step reads the rows once, however many cuts a stratum has. The
    tables of cuts have one row per (stratum, cut), all else stays where it is."""
    rows = df.select((F.col(strata) if strata else F.lit(0)).alias("stratum"), hash_order(key, seed).alias("_h"), F.col(key).alias("_key"))
    spark = df.sparkSession
    cuts = ranks.select("stratum", "cut", F.col("rank").cast("long").alias("rank"), F.lit("").alias("prefix"))
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)

    def below(x: DataFrame, hashed: str, at: DataFrame) -> DataFrame:
        here = F.col("r.stratum").eqNullSafe(F.col("c.stratum")) & F.col(f"r.{hashed}").startswith(F.col("c.prefix"))
        return x.alias("r").join(small(at.alias("c")), here)

    for digits in range(DIGITS, 33, DIGITS):
        near = rows.alias("r") if digits == DIGITS else below(rows, "_h", cuts.select("stratum", "prefix").distinct())
        counts = near.groupBy(F.col("r.stratum").alias("stratum"), F.substring("_h", 1, digits).alias("prefix")).agg(F.count("*").alias("n"))
        each = below(counts, "prefix", cuts).select(F.col("c.stratum").alias("stratum"), "cut", "rank", F.col("r.prefix").alias("prefix"), "n")
        upto = F.sum("n").over(Window.partitionBy("stratum", "cut").orderBy("prefix"))
        found = each.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        listed = found.select("stratum", "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "prefix", "n").collect()
        cuts = spark.createDataFrame([(r["stratum"], r["cut"], r["rank"], r["prefix"]) for r in listed], cuts.schema)
        if all(r["n"] <= NEAR_CUT for r in listed):
            break
    place = F.row_number().over(Window.partitionBy("c.stratum", "cut").orderBy("_h", "_key"))
    ranked = below(rows, "_h", cuts).withColumn("_place", place).where(F.col("_place") == F.col("rank"))
    # one row per (stratum, cut), kept: every reader would rank the rows again
    ends = ranked.select(F.col("c.stratum").alias("stratum"), "cut", "_h", "_key")
    return spark.createDataFrame(ends.collect(), ends.schema)


def _upto(df: DataFrame, key: str, strata: str | None, cuts: DataFrame, names: Sequence[str], seed: str | int) -> tuple[DataFrame, list[Column]]:
    """``df`` with, per cut name, a condition that holds for rows up to the
    cut of their stratum (false without one). The cuts are one row per stratum."""
    here = F.struct("_h", "_key")
    wide = cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("cut") == n, here)).alias(f"_cut_{n}") for n in names])
    x = df.withColumn("_at", F.struct(hash_order(key, seed).alias("_h"), F.col(key).alias("_key")))
    joined = x.join(small(wide), (x[strata] if strata else F.lit(0)).eqNullSafe(wide["stratum"]), "left").drop("stratum")
    return joined, [F.coalesce(F.col("_at") <= F.col(f"_cut_{n}"), F.lit(False)) for n in names]


def stratified_split(df: DataFrame, key: str, strata: str, test: float = 0.15, val: float = 0.15,
                     seed: str | int = 42, out: str = "split") -> DataFrame:
    """Add ``out`` ∈ {train, val, test}: the first round(n·test) rows of each
    stratum in hash order are test, the next up to round(n·(test+val)) val.
    A null stratum is one of its own; an empty table stays empty."""
    n = df.groupBy(F.col(strata).alias("stratum")).agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.lit("test").alias("cut"), F.bround(F.col("n") * F.lit(test), 0).alias("rank")),
                   F.struct(F.lit("val").alias("cut"), F.bround(F.col("n") * F.lit(test + val), 0).alias("rank")))
    ranks = n.select("stratum", F.explode(ends).alias("e")).select("stratum", "e.*").where("rank > 0")
    x, (is_test, is_val) = _upto(df, key, strata, cut_points(df, key, strata, ranks, seed), ["test", "val"], seed)
    return x.withColumn(out, F.when(is_test, "test").when(is_val, "val").otherwise("train")).drop("_at", "_cut_test", "_cut_val")


def stratum_quotas(df: DataFrame, strata: str, n: int) -> DataFrame:
    """Largest-remainder allocation of ``n`` rows over strata proportional to
    their size (remainder ties by stratum name). One row per stratum."""
    g = df.groupBy(strata).agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy()
    total = F.sum("size").over(w)
    take_all = F.lit(n) >= total
    exact = F.col("size") * F.lit(n) / total
    base = F.when(take_all, F.col("size")).otherwise(F.floor(exact))
    g = g.withColumn("_base", base.cast("long")).withColumn("_frac", F.when(take_all, 0.0).otherwise(exact - F.floor(exact)))
    left = F.when(take_all, 0).otherwise(F.lit(n) - F.sum("_base").over(w))
    g = g.withColumn("_left", left).withColumn("_rk", F.row_number().over(Window.orderBy(F.col("_frac").desc(), F.col(strata))))
    quota = F.col("_base") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)
    return g.select(strata, F.col("size").cast("long").alias("size"), quota.cast("long").alias("quota"))


def stratified_sample(df: DataFrame, key: str, strata: str, n: int, seed: str | int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, stratified; the first ``quota`` rows of each
    stratum in hash order. The quota table has one row per stratum."""
    ranks = stratum_quotas(df, strata, n).select(F.col(strata).alias("stratum"), F.lit("end").alias("cut"), F.col("quota").alias("rank")).where("rank > 0")
    x, (taken,) = _upto(df, key, strata, cut_points(df, key, strata, ranks, seed), ["end"], seed)
    return x.filter(taken).drop("_at", "_cut_end")


def uniform_sample(df: DataFrame, key: str, n: int, seed: str | int = 42) -> DataFrame:
    """min(n, rows) rows without replacement: the first n in hash order."""
    ranks = df.agg(F.lit(0).alias("stratum"), F.lit("end").alias("cut"), F.least(F.count("*"), F.lit(n)).alias("rank")).where("rank > 0")
    x, (taken,) = _upto(df, key, None, cut_points(df, key, None, ranks, seed), ["end"], seed)
    return x.filter(taken).drop("_at", "_cut_end")


def split_distribution(df: DataFrame, split: str, label: str) -> DataFrame:
    """Share (%) of each label inside each split; the window runs over the
    grouped table."""
    g = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return g.select(
        split,
        label,
        F.col("n").cast("long").alias("n"),
        (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(split))).alias("pct"),
    )


def cumulative_cut(values: Sequence[float], share: float) -> int:
    """Smallest k with cumulative share above ``share`` (driver-side on p
    numbers, e.g. explained variances)."""
    total = float(sum(values)) or 1.0
    acc = 0.0
    for k, v in enumerate(values, start=1):
        acc += v / total
        if acc > share:
            return k
    return len(values)

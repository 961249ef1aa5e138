"""Row positions and prefix sums in a total order, without a single task.

``Window.partitionBy(k).orderBy(o)`` with ``row_number`` moves every row of a
key into one task; a key holding a third of the rows then becomes one task
holding a third of the data, and a window without keys is a single task.
Here rows are range-partitioned over (keys, order) and sorted, so a hot key
spans many partitions, and written once to the shared folder with their
partition and their place in it: one shuffle, and every consumer and every
retried task reads the same placement. The plan does not grow with the number
of partitions. Offsets from earlier partitions come from count tables: one
row per partition (broadcast with that bound), or one row per (partition,
key), joined on both, so a hot key stays spread over its partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_PLACE_BITS = 33  # monotonically_increasing_id: partition above, place in the partition below


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, sort_cols: Sequence[str], n_partitions: int) -> DataFrame:
    """``df`` sorted over ``n_partitions`` range partitions and written, with
    ``_bkt`` (partition, in the order of the columns) and ``_place`` (0-based
    place in it)."""
    cols = [F.col(c) for c in sort_cols]
    x = df.repartitionByRange(max(1, n_partitions), *cols).sortWithinPartitions(*cols)
    path = scratch_path(df.sparkSession, "ranged")
    x.withColumn("_mid", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(x.withColumn("_mid", F.lit(0).cast("long")).schema).parquet(path)
    mask = F.lit((1 << _PLACE_BITS) - 1)
    return back.withColumns({"_bkt": F.shiftright("_mid", _PLACE_BITS).cast("int"), "_place": F.col("_mid").bitwiseAND(mask)}).drop("_mid")


def positions(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    out: str = "pos",
    count_out: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of each row within ``partition_by`` in
    ascending ``order_by`` order (``order_by`` must make the order total), and
    optionally ``count_out`` = number of rows of its group.

    Rows are range-partitioned, sorted and written (``ranged``); what is left
    is to subtract a group's first place in a partition and to add its rows in
    earlier partitions, from a table of counts: one row per partition, or with
    keys one row per (partition, key)."""
    keys = list(partition_by)
    x = ranged(df, keys + list(order_by), _num_partitions(df, num_partitions))
    counts = x.groupBy("_bkt", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    if not keys:
        w_all = Window.orderBy("_bkt")
        per = counts.select(
            "_bkt",
            F.coalesce(F.sum("_n").over(w_all.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
            F.sum("_n").over(w_all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
        )
        res = x.join(F.broadcast(per), on="_bkt", how="left").withColumn(out, F.col("_place") + F.col("_off"))
        if count_out:
            res = res.withColumn(count_out, F.col("__total"))
        return res.drop("_bkt", "_place", "_off", "__total")
    wk = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wk), F.lit(0)) - F.col("_first"))
    if count_out:
        offsets = offsets.withColumn(count_out, F.sum("_n").over(Window.partitionBy(*keys)))
    here = F.col("_o._bkt") == F.col("_x._bkt")
    for k in keys:
        here = here & F.col(f"_o.{k}").eqNullSafe(F.col(f"_x.{k}"))
    res = x.alias("_x").join(offsets.alias("_o"), here)
    cols = [F.col(f"_x.{c}") for c in df.columns] + [(F.col("_x._place") + F.col("_o._off")).alias(out)]
    return res.select(*cols, *([F.col(f"_o.{count_out}")] if count_out else []))


def running_sums(
    df: DataFrame,
    values: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    out_prefix: str = "cum_",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``<prefix><v>`` = sum of ``v`` over rows up to and including this
    one within ``partition_by`` in ascending ``order_by`` order: a prefix sum
    per range partition (window) plus the sums of the same key in earlier
    ones (only a partition's first key has any: one carry row per partition)."""
    keys = list(partition_by)
    vals = list(values)
    x = ranged(df, keys + list(order_by), _num_partitions(df, num_partitions)).drop("_place")
    w = Window.partitionBy("_bkt", *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"{out_prefix}{v}": F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).over(w) for v in vals})
    totals = x.groupBy("_bkt", *keys).agg(*[F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(f"_t_{v}") for v in vals])
    wk = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_bkt", *keys, F.count(F.lit(1)).over(wk).alias("_earlier"), *[F.sum(f"_t_{v}").over(wk).alias(f"_o_{v}") for v in vals])
    carry = offs.filter(F.col("_earlier") > 0).drop("_earlier")
    res = x.join(F.broadcast(carry), on=["_bkt", *keys], how="left")
    res = res.withColumns({f"{out_prefix}{v}": F.col(f"{out_prefix}{v}") + F.coalesce(F.col(f"_o_{v}"), F.lit(0.0)) for v in vals})
    return res.drop("_bkt", *[f"_o_{v}" for v in vals])


def last_before(df: DataFrame, value: str, order_by: Sequence[str], out: str, num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = the last non-null ``value`` of earlier rows in
    ``order_by`` order (null without one): within a range partition by a
    window, before it from a table of one row per partition."""
    x = ranged(df, list(order_by), _num_partitions(df, num_partitions))
    here = F.last(value, True).over(Window.partitionBy("_bkt").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    ends = x.groupBy("_bkt").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_place"))).alias("_end"))
    earlier = F.last("_end", True).over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1))
    res = x.withColumn(out, here).join(F.broadcast(ends.select("_bkt", earlier.alias("_carry"))), "_bkt")
    return res.withColumn(out, F.coalesce(out, "_carry")).drop("_bkt", "_place", "_carry")

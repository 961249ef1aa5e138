"""Count-based trailing windows ("the last N rows") without a single task.

``Window.orderBy(o).rowsBetween(-(N-1), 0)`` with no partition key runs in
one task, and a keyed window puts a hot key in one task. Here rows get a
position (``ordering.positions``), are cut into blocks of ``block`` rows per
key, and the last N-1 rows of each block are copied into the next block as
context. The window then runs per (key, block) and only the block's own
rows are kept, so the result equals the global window while every task holds
at most ``block + N - 1`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions


def blocked(df: DataFrame, size: int, partition_by: Sequence[str] = (), pos: str = "pos", block: int | None = None) -> tuple[DataFrame, Window]:
    """Rows (with a ``pos`` column) plus context copies, and the window spec
    (partition = keys + block, order = pos, frame = last ``size`` rows). Keep
    rows with ``_home`` after applying the window."""
    keys = list(partition_by)
    b = int(block or max(10_000, 100 * size))
    if b < size:
        raise ValueError("block must be at least the window size")
    blk = F.floor(F.col(pos) / F.lit(b)).cast("long")
    in_tail = (F.col(pos) % F.lit(b)) >= F.lit(b - (size - 1))
    copies = F.when(
        in_tail & F.lit(size > 1),
        F.array(F.struct(blk.alias("_blk"), F.lit(True).alias("_home")), F.struct((blk + 1).alias("_blk"), F.lit(False).alias("_home"))),
    ).otherwise(F.array(F.struct(blk.alias("_blk"), F.lit(True).alias("_home"))))
    x = df.withColumn("_c", F.explode(copies)).select("*", "_c._blk", "_c._home").drop("_c")
    w = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-(size - 1), 0)
    return x, w


def trailing(df: DataFrame, order_by: Sequence[str], size: int, aggs: Callable[[Window], list[Column]],
             partition_by: Sequence[str] = (), pos: str = "pos", block: int | None = None,
             with_positions: bool = True, count_out: str | None = None) -> DataFrame:
    """Apply ``aggs(window)`` over the trailing ``size`` rows of every row
    (``count_out`` also adds the number of rows of the row's key)."""
    x = positions(df, order_by=order_by, partition_by=partition_by, out=pos, count_out=count_out) if with_positions else df
    xb, w = blocked(x, size, partition_by, pos, block)
    cols = aggs(w)
    return xb.select("*", *cols).filter(F.col("_home")).drop("_blk", "_home")

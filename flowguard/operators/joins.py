"""Join hints behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (label
    tables have one row per class): the other side, where a label may hold
    most rows, then stays where it is. With more rows the hint is left out
    and the planner picks a shuffled join, whose skew AQE splits."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

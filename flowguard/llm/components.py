"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node on an edge to another node; component is the least node of its component.

    Each round rewires the edges to point at lesser nodes and is written to the shared folder; neighbourhoods enter only
    as minima (combined before the shuffle) and as joins that AQE can split, so a hub of any degree is fine. Rows with a
    null end and loops link nothing; repeated edges count once; without edges the result is empty.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(pairs.distinct(), "components")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where(F.col("y") > F.col("x")).join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        if (new := _state(now)) == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

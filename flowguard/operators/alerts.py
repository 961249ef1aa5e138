"""Operational alerts (L1–L10).

* ``request_windows``: error rate and nearest-rank p95 latency over the last
  N requests (block-parallel trailing window), with the evaluation guard.
* ``cooldown``: greedy per-key cooldown ("send if at least C seconds since the
  last *sent* event"), exact and distributed:

  1. events are reduced to distinct whole seconds per key, written once;
  2. a key of at most ``SINGLE_ROWS`` seconds is replayed in one group;
  3. a larger key is cut into chunks of time no shorter than the cooldown, so
     that a chunk depends on the ones before only by the second from which on
     it may send. A chunk is a step function of that second, and step functions
     compose: groups of ``FAN`` are composed in a tree, the seconds handed down
     it, and each chunk is replayed from its own.

  No task holds more than one chunk of a key, or ``FAN`` functions of at most
  ``cooldown`` + 1 steps each.
* ``active`` / ``recent`` / ``counts`` / ``message`` / ``channels``: columns and
  aggregates over the alert history.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import nearest_rank
from ..session import scratch_path
from .joins import small
from .windows import trailing

# Fixed values (defaults of the reference service).
REQUEST_WINDOW = 50
REQUEST_MIN_WINDOW = 10
ERROR_RATE_THRESHOLD = 0.30
LATENCY_P95_THRESHOLD = 3.0
F1_MACRO_MIN = 0.90
COOLDOWN_SECONDS = 300
INTERNAL_ENDPOINTS = ("/metrics", "/health")
KEY_ERROR_RATE = "operational_http_error_rate"
KEY_LATENCY = "operational_high_latency"
KEY_MODEL_F1 = "model_f1_macro_low"
METADATA_MAX = 1200
TEXT_MAX = 3900
MESSAGE_HEADER = "[alert]"


def request_windows(requests: DataFrame, order: str = "seq", size: int = REQUEST_WINDOW, minimum: int = REQUEST_MIN_WINDOW,
                    error_threshold: float = ERROR_RATE_THRESHOLD, p95_threshold: float = LATENCY_P95_THRESHOLD,
                    partition_by: Sequence[str] = (), with_positions: bool = True, block: int | None = None) -> DataFrame:
    """Per request (internal endpoints excluded): window size, errors, error
    rate, p95 of durations (nearest rank, half-even index), and whether each
    alert fires (only once ``minimum`` requests are in the window). Without
    ``with_positions`` the rows have their ``pos`` already."""
    r = requests.filter(~F.col("endpoint").isin(*INTERNAL_ENDPOINTS))

    def aggs(w):
        return [
            F.count(F.lit(1)).over(w).alias("window_n"),
            F.sum((F.col("http_status") >= 400).cast("int")).over(w).alias("errors"),
            F.array_sort(F.collect_list(F.col("duration").cast("double")).over(w)).alias("_durs"),
        ]

    x = trailing(r, [order], size, aggs, partition_by=partition_by, pos="pos", block=block, with_positions=with_positions)
    rate = F.col("errors") / F.col("window_n")
    p95 = nearest_rank(F.col("_durs"), F.col("window_n"), 0.95)
    evaluated = F.col("window_n") >= F.lit(minimum)
    return x.withColumns({
        "error_rate": rate,
        "p95_latency": F.when(evaluated, p95),
        "evaluated": evaluated,
        "error_rate_alert": evaluated & (rate >= F.lit(error_threshold)),
        "latency_alert": evaluated & (p95 >= F.lit(p95_threshold)),
    }).drop("_durs")


def alert_actions(windows: DataFrame, ts: str = "ts", order: str = "seq") -> DataFrame:
    """Evaluated requests → one trigger / resolve action per alert key."""
    ev = windows.filter(F.col("evaluated"))
    acts = F.explode(F.array(
        F.struct(F.lit(KEY_ERROR_RATE).alias("key"), F.col("error_rate_alert").alias("fire")),
        F.struct(F.lit(KEY_LATENCY).alias("key"), F.col("latency_alert").alias("fire")),
    ))
    x = ev.select(order, ts, "error_rate", "p95_latency", "window_n", "errors", acts.alias("a")).select("*", "a.key", "a.fire").drop("a")
    return x.withColumns({
        "action": F.when(F.col("fire"), "trigger").otherwise("resolve"),
        "category": F.lit("operational"),
        "severity": F.lit("warning"),
    })


# ---------------------------------------------------------------------------
# greedy cooldown
# ---------------------------------------------------------------------------


SINGLE_ROWS = 65_536  # distinct seconds of a key that one task replays at once
CHUNK_SECONDS = 65_536
FAN = 32  # functions that one step of the tree composes
_EVER = -(2**62)  # before any second: nothing was sent


def _sent(seconds: np.ndarray, since: int, cooldown: int) -> np.ndarray:
    """The sent ones of sorted seconds, if sending is possible from ``since`` on."""
    after = np.searchsorted(seconds, seconds + cooldown)
    out, i = [], int(np.searchsorted(seconds, since))
    while i < len(seconds):
        out.append(i)
        i = int(after[i])
    return seconds[out]


def _steps(bounds: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same function without steps between equal values."""
    real = outs[1:] != outs[:-1]
    return bounds[real], np.append(outs[:-1][real], outs[-1])


def _function(seconds: np.ndarray, upto: int, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """From when a chunk may send, to when what follows may: value i holds
    above bound i - 1 and up to bound i. ``upto``: the highest argument."""
    ends = np.searchsorted(seconds, seconds + cooldown)
    ends = np.where(ends == len(seconds), np.arange(len(seconds)), ends)
    while True:  # each send to the last one of its chain
        further = ends[ends]
        if (further == ends).all():
            break
        ends = further
    n = min(len(seconds), int(np.searchsorted(seconds, upto)) + 1)
    return _steps(seconds[:n], np.append(seconds[ends[:n]] + cooldown, _EVER))


def _apply(bounds: np.ndarray, outs: np.ndarray, since):
    return outs[np.searchsorted(bounds, since)]


def _tree(chunks: DataFrame, key_type: str, n_part: int) -> DataFrame:
    """(k, node, since): from when each chunk may send, from the chunks'
    functions (k, node, bounds, outs)."""
    spark, levels, schema = chunks.sparkSession, [chunks], chunks.schema
    up = F.floor(F.col("node") / FAN).cast("long")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        bounds, outs = np.asarray(pdf["bounds"].iloc[0], np.int64), np.asarray(pdf["outs"].iloc[0], np.int64)
        for b, o in zip(pdf["bounds"].iloc[1:], pdf["outs"].iloc[1:]):
            bounds, outs = _steps(bounds, _apply(np.asarray(b, np.int64), np.asarray(o, np.int64), outs))
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "node": [int(pdf["node"].iloc[0]) // FAN], "bounds": [bounds], "outs": [outs]})

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        since = [int(pdf["since"].iloc[0])]
        for b, o in zip(pdf["bounds"], pdf["outs"]):
            since.append(int(_apply(np.asarray(b, np.int64), np.asarray(o, np.int64), since[-1])))
        return pd.DataFrame({"k": pdf["k"], "node": pdf["node"], "since": since[:-1]})

    while (levels[-1].groupBy("k").count().agg(F.max("count")).first()[0] or 0) > FAN:
        path = scratch_path(spark, "cooldown-functions")
        levels[-1].withColumn("_up", up).repartition(n_part, "k", "_up").groupBy("k", "_up").applyInPandas(compose, schema).write.parquet(path)
        levels.append(spark.read.schema(schema).parquet(path))
    out_schema = f"k {key_type}, node long, since long"
    out = levels[-1].withColumn("since", F.lit(_EVER)).repartition(n_part, "k").groupBy("k").applyInPandas(hand_down, out_schema)
    for level in reversed(levels[:-1]):
        of = out.select(F.col("k").alias("_k"), F.col("node").alias("_up"), "since")
        joined = level.withColumn("_at", up).join(of, F.col("k").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_up")))
        out = joined.repartition(n_part, "k", "_up").groupBy("k", "_up").applyInPandas(hand_down, out_schema)
    return out


def cooldown(events: DataFrame, key: str, ts: str, seconds: int = COOLDOWN_SECONDS, chunk_buckets: int | None = None, single_rows: int = SINGLE_ROWS) -> DataFrame:
    """Sends of a greedy per-key cooldown on whole seconds: (key, t) where t
    is a Unix second. Exact; see the module docstring for the plan. A null
    time is no event, a null key is a key; ``chunk_buckets`` is the length of
    a chunk in cooldowns."""
    C = int(seconds)
    length = C * chunk_buckets if chunk_buckets else max(C, CHUNK_SECONDS)
    spark = events.sparkSession
    e = events.select(F.col(key).alias("k"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("t")).filter(F.col("t").isNotNull()).distinct()
    path, schema = scratch_path(spark, "cooldown-seconds"), e.schema
    e.write.parquet(path)
    e = spark.read.schema(schema).parquet(path)
    kt = dict(e.dtypes)["k"]
    # explicit partition counts: the Python stages stay spread over all tasks
    # (AQE would merge small shuffles into one task); grouping reuses them
    n_part = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _sent(np.sort(pdf["t"].to_numpy(np.int64)), int(pdf["since"].iloc[0]), C)
        return pd.DataFrame({"k": pd.Series([pdf["k"].iloc[0]] * len(t), dtype=pdf["k"].dtype), "t": t})

    large = e.groupBy("k").count().filter(F.col("count") > single_rows).select(F.col("k").alias("_k"))
    same = F.col("k").eqNullSafe(F.col("_k"))
    out_schema = f"k {kt}, t long"
    few = small(large)
    alone = e.join(few, same, "left_anti").withColumn("since", F.lit(_EVER))
    sends = alone.repartition(n_part, "k").groupBy("k").applyInPandas(replay, out_schema)
    if large.isEmpty():
        return sends.withColumnRenamed("k", key)
    rows = e.join(few, same, "left_semi").withColumn("node", F.floor(F.col("t") / length).cast("long"))

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["node"].iloc[0])
        bounds, outs = _function(np.sort(pdf["t"].to_numpy(np.int64)), node * length + C, C)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "node": [node], "bounds": [bounds], "outs": [outs]})

    path, schema = scratch_path(spark, "cooldown-functions"), f"k {kt}, node long, bounds array<bigint>, outs array<bigint>"
    rows.repartition(n_part, "k", "node").groupBy("k", "node").applyInPandas(function, schema).write.parquet(path)
    since = _tree(spark.read.schema(schema).parquet(path), kt, n_part).select(F.col("k").alias("_k"), F.col("node").alias("_node"), "since")
    joined = rows.join(since, same & (F.col("node") == F.col("_node")))
    many = joined.repartition(n_part, "k", "node").groupBy("k", "node").applyInPandas(replay, out_schema)
    return sends.unionByName(many).withColumnRenamed("k", key)


# ---------------------------------------------------------------------------
# history views
# ---------------------------------------------------------------------------


def active_alerts(actions: DataFrame, sent: DataFrame, key: str = "key", order: str = "seq", reset_at: object | None = None) -> DataFrame:
    """Latest action per key; active when it is a trigger; ``cooldown_active``
    when that trigger was not sent (inside the cooldown). Actions before the
    last reset of the alert state, ``reset_at``, count no more."""
    if reset_at is not None:
        actions = actions.filter(F.col("ts") >= F.lit(reset_at))
    s = sent.select(F.col(key).alias("_k"), F.col("t").alias("_t"), F.lit(True).alias("_sent"))
    a = actions.withColumn("_t", F.unix_seconds(F.col("ts").cast("timestamp")))
    last = a.groupBy(key).agg(F.max_by(F.struct(order, "action", "_t", "category", "severity"), F.col(order)).alias("l"))
    last = last.select(key, "l.*")
    j = last.join(s, (last[key] == s["_k"]) & (last["_t"] == s["_t"]), "left")
    return j.filter(F.col("action") == "trigger").select(
        key, order, "category", "severity", (~F.coalesce(F.col("_sent"), F.lit(False))).alias("cooldown_active"))


def alert_channels(token: Column | None = None, chat: Column | None = None) -> Column:
    ext = F.when(token.isNotNull() & chat.isNotNull(), F.lit("telegram")) if token is not None and chat is not None else F.lit(None).cast("string")
    return F.array_compact(F.array(F.lit("local_history"), ext))


def message(fields: dict[str, Column], metadata_json: Column, header: str = MESSAGE_HEADER, metadata_max: int = METADATA_MAX,
            text_max: int = TEXT_MAX) -> Column:
    """Alert text: a header line, a line ``name: value`` for each of ``fields``
    in order (null values are left out) and, if there is any, the metadata,
    cut at ``metadata_max`` characters; the text is cut at ``text_max``. What
    is cut ends in a line with three dots."""

    def cut(text: Column, most: int) -> Column:
        return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n..."))).otherwise(text)

    lines = F.concat_ws("\n", F.lit(header), *[F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()])
    meta = F.when(metadata_json != "{}", F.concat(F.lit("\n\nmetadata:\n"), cut(metadata_json, metadata_max)))
    return cut(F.concat(lines, F.coalesce(meta, F.lit(""))), text_max)

"""Registered queries: drift profile, scores, rolling windows, alerts and
status (D1–D10) over the transformed ``flows`` features.

The reference profile is built from validation rows of the normal class
(hash order, as in the split); the monitored stream is the test split in
arrival order ``(ts, sample_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import r6
from ..operators import drift as dr
from ..operators.sampling import hash_order
from . import prep_queries as pq
from .registry import query
from .sqlkit import CATEGORICAL, flows_sql

STREAM_ORDER = ["ts", "sample_id"]
REF_ORDER = ["_h", "sample_id"]

_FEATS = pq._NUM + [f"{c}_{v}" for c in CATEGORICAL for v in pq._CATS[c]]
_REF_CACHE: dict[tuple, tuple] = {}


def _q(c: str) -> str:
    return f'"{c}"'


def reference(spark: SparkSession, sf_dir: str):
    """(preparation, transformed frame, reference) once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _REF_CACHE:
        prep, fin = pq.final_features(spark, sf_dir)
        rows = reference_rows(fin)
        ref = dr.build_reference(rows, prep.features, REF_ORDER)
        _REF_CACHE[key] = (prep, fin, ref)
    return _REF_CACHE[key]


def reference_rows(fin: DataFrame) -> DataFrame:
    val = fin.filter(F.col("split") == "val")
    has_normal = val.filter(F.col("class3") == "normal").limit(1).count() > 0
    rows = val.filter(F.col("class3") == "normal") if has_normal else val
    return rows.withColumn("_h", hash_order("sample_id", "42"))


def stream(spark: SparkSession, sf_dir: str, with_flags: bool = False) -> tuple[DataFrame, dr.Reference]:
    prep, fin, ref = reference(spark, sf_dir)
    s = fin.filter(F.col("split") == "test")
    # windows order, write and copy whole rows: the features end with the scores and flags made of them
    return dr.row_scores(s, ref, with_flags=with_flags).drop(*ref.features), ref


def rolled(spark: SparkSession, sf_dir: str, keyed: bool = False, with_flags: bool = False):
    s, ref = stream(spark, sf_dir, with_flags)
    extra = [f"oor_{c}" for c in ref.features] if with_flags else []
    r = dr.rolling(s, STREAM_ORDER, partition_by=["service"] if keyed else [], size=ref.window_size, extra=extra)
    return dr.alerts(r, ref), ref


# --------------------------------------------------------------------------- SQL
_FIN_CTE = "fin as (select sample_id, split, class3, ts, service, " + ", ".join(
    [f"(i_{c} - med_{c}) / sc_{c} as {c}" for c in pq._NUM]
    + [f"cast(coalesce({c}, 'missing') = '{v}' as double) as \"{c}_{v}\"" for c in CATEGORICAL for v in pq._CATS[c]]
) + " from imp, qs)"
_REF_CTE = "ref as (select * from fin where split = 'val' and class3 = 'normal')"
_STATS_CTE = "st as (" + " union all ".join(
    f"""select '{f}' as feature, avg({_q(f)}) as mean, stddev_pop({_q(f)}) as std, quantile_cont({_q(f)}, 0.01) as q_low,
  quantile_cont({_q(f)}, 0.25) as q25, quantile_cont({_q(f)}, 0.5) as median, quantile_cont({_q(f)}, 0.75) as q75,
  quantile_cont({_q(f)}, 0.99) as q_high from ref"""
    for f in _FEATS
) + ")"
_BOUNDS_CTE = "b as (select " + ", ".join(
    f"max(case when feature = '{f}' then q_low end) as lo{i}, max(case when feature = '{f}' then q_high end) as hi{i}" for i, f in enumerate(_FEATS)
) + " from st)"


def _score_sql(src: str) -> str:
    terms = " + ".join(f"case when {_q(f)} < lo{i} or {_q(f)} > hi{i} then 1 else 0 end" for i, f in enumerate(_FEATS))
    return f"(({terms}) / {float(len(_FEATS))})"


def _flag_cols() -> str:
    return ", ".join(f"case when {_q(f)} < lo{i} or {_q(f)} > hi{i} then 1.0 else 0.0 end as \"oor_{f}\"" for i, f in enumerate(_FEATS))


_REF_SCORES = f"rs as (select sample_id, {_score_sql('ref')} as score, row_number() over (order by md5(sample_id || '42'), sample_id) - 1 as pos from ref, b)"
_BLOCKS = """blocks as (select case when (select count(*) from rs) < 100 then 0 else pos // 100 end as block, avg(score) as window_score, count(*) as n
  from rs where (select count(*) from rs) < 100 or pos < ((select count(*) from rs) // 100) * 100 group by 1)"""
_THR = """thr as (select greatest(quantile_cont(score, 0.99), 0.15) as sample_threshold, avg(score) as sample_score_mean,
  quantile_cont(score, 0.95) as sample_score_p95, quantile_cont(score, 0.99) as sample_score_p99, count(*) as reference_rows,
  (select quantile_cont(window_score, 0.99) from blocks) as window_score_p99,
  greatest((select quantile_cont(window_score, 0.99) from blocks), 0.15) as window_threshold from rs)"""
_STREAM = f"""ss as (select sample_id, service, ts, {_score_sql('fin')} as score, {_flag_cols()},
  row_number() over (order by ts, sample_id) - 1 as pos from fin, b where split = 'test')"""
_ROLL = """ro as (select *, avg(score) over (order by pos rows between 99 preceding and current row) as rolling_score,
  count(*) over (order by pos rows between 99 preceding and current row) as window_observations from ss)"""
_ALERT = """al as (select ro.*, score >= sample_threshold as sample_alert,
  window_observations >= 30 and rolling_score >= window_threshold as window_alert from ro, thr)"""

_DRIFT_CTES = [*pq._PARAM_CTES, _FIN_CTE, _REF_CTE, _STATS_CTE, _BOUNDS_CTE, _REF_SCORES, _BLOCKS, _THR]


def _dsql(body: str, *more: str) -> str:
    return flows_sql(body, *_DRIFT_CTES, *more)


# --------------------------------------------------------------------------- queries
@query("reference_rows", group="D", oracle=_dsql("select sample_id, class3 from ref"))
def q_reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, fin = pq.final_features(spark, sf_dir)
    return reference_rows(fin).select("sample_id", "class3")


@query(
    "profile_stats",
    group="D",
    oracle=_dsql(
        """select feature, round(coalesce(mean, 0.0), 6) as mean, round(coalesce(median, mean, 0.0), 6) as median,
  round(greatest(coalesce(std, 0.0), 1e-6), 6) as std, round(greatest(coalesce(q75 - q25, 0.0), 1e-6), 6) as iqr,
  round(least(q_low, q_high), 6) as q_low, round(greatest(q_low, q_high), 6) as q_high from st"""
    ),
)
def q_profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ref = reference(spark, sf_dir)
    t = spark.createDataFrame(ref.stats_rows(), "feature string, mean double, median double, std double, iqr double, q_low double, q_high double")
    return t.select("feature", *[r6(c).alias(c) for c in ["mean", "median", "std", "iqr", "q_low", "q_high"]])


@query("out_of_range_score", group="D", oracle=_dsql(f"select sample_id, split, round({_score_sql('fin')}, 6) as score from fin, b"))
def q_out_of_range_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, fin, ref = reference(spark, sf_dir)
    return dr.row_scores(fin, ref).select("sample_id", "split", r6("score").alias("score"))


@query("tumbling_scores", group="D", oracle=_dsql("select block::bigint as block, round(window_score, 6) as window_score, n::bigint as n from blocks"))
def q_tumbling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, fin, ref = reference(spark, sf_dir)
    scored = dr.row_scores(reference_rows(fin), ref)
    t = dr.tumbling_scores(scored, REF_ORDER, ref.window_size)
    return t.select(F.col("block").cast("long").alias("block"), r6("window_score").alias("window_score"), F.col("n").cast("long").alias("n"))


@query(
    "thresholds",
    group="D",
    oracle=_dsql(
        """select round(sample_threshold, 6) as sample_threshold, round(window_threshold, 6) as window_threshold,
  round(sample_score_mean, 6) as sample_score_mean, round(sample_score_p95, 6) as sample_score_p95,
  round(sample_score_p99, 6) as sample_score_p99, round(window_score_p99, 6) as window_score_p99, reference_rows::bigint as reference_rows from thr"""
    ),
)
def q_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ref = reference(spark, sf_dir)
    row = (ref.sample_threshold, ref.window_threshold, ref.baseline["sample_score_mean"], ref.baseline["sample_score_p95"],
           ref.baseline["sample_score_p99"], ref.baseline["window_score_p99"], ref.reference_rows)
    t = spark.createDataFrame([row], "sample_threshold double, window_threshold double, sample_score_mean double, sample_score_p95 double, "
                              "sample_score_p99 double, window_score_p99 double, reference_rows long")
    return t.select(*[r6(c).alias(c) if c != "reference_rows" else F.col(c) for c in t.columns])


@query(
    "rolling_drift",
    group="D",
    oracle=_dsql("select sample_id, pos::bigint as pos, rolling_score, window_observations::bigint as window_observations from ro", _STREAM, _ROLL),
)
def q_rolling_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = rolled(spark, sf_dir)
    return r.select("sample_id", F.col("pos").cast("long").alias("pos"), "rolling_score",
                    F.col("window_observations").cast("long").alias("window_observations"))


@query(
    "rolling_drift_keyed",
    group="D",
    oracle=_dsql(
        """select sample_id, service, (row_number() over (partition by service order by ts, sample_id) - 1)::bigint as pos,
  avg(score) over w as rolling_score, (count(*) over w)::bigint as window_observations
from ss window w as (partition by service order by ts, sample_id rows between 99 preceding and current row)""",
        _STREAM,
    ),
)
def q_rolling_drift_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = rolled(spark, sf_dir, keyed=True)
    return r.select("sample_id", "service", F.col("pos").cast("long").alias("pos"), "rolling_score",
                    F.col("window_observations").cast("long").alias("window_observations"))


@query(
    "drift_alert",
    group="D",
    oracle=_dsql(
        f"""select sample_id, sample_alert, window_alert, sample_alert or window_alert as alert_active,
  case when window_alert then '{dr.REASON_WINDOW}' when sample_alert then '{dr.REASON_SAMPLE}' end as alert_reason from al""",
        _STREAM, _ROLL, _ALERT,
    ),
)
def q_drift_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = rolled(spark, sf_dir)
    return r.select("sample_id", "sample_alert", "window_alert", "alert_active", "alert_reason")


_TOP_SQL = "top as (select feature, out_of_range_ratio, row_number() over (order by out_of_range_ratio desc, feature) as rank from (" + " union all ".join(
    f"select '{f}' as feature, avg(\"oor_{f}\") as out_of_range_ratio from ss where pos >= (select count(*) from ss) - 100" for f in _FEATS
) + ") x where out_of_range_ratio > 0)"


@query(
    "drift_top_features",
    group="D",
    oracle=_dsql("select feature, out_of_range_ratio, rank::int as rank from top where rank <= 5", _STREAM, _TOP_SQL),
)
def q_drift_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _last_window_ratios(spark, sf_dir)
    _, _, ref = reference(spark, sf_dir)
    t = dr.top_features(last, ref.features)
    return t.select("feature", "out_of_range_ratio", F.col("rank").cast("int").alias("rank"))


def _last_window_ratios(spark: SparkSession, sf_dir: str, rolled_flags: DataFrame | None = None) -> DataFrame:
    """Per-feature out-of-range ratios over the window that ends at the last
    row of the stream (one row), from the rolled frame's positions."""
    _, _, ref = reference(spark, sf_dir)
    r = rolled_flags if rolled_flags is not None else _rolled_with_flags(spark, sf_dir)
    last = r.filter(F.col("pos") >= F.col("stream_rows") - F.lit(ref.window_size))
    return last.agg(*[F.avg(F.col(f"oor_{c}").cast("double")).alias(f"ratio_oor_{c}") for c in ref.features])


def _rolled_with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled stream that keeps the per-feature flags as row columns (the
    window itself only averages the score)."""
    s, ref = stream(spark, sf_dir, with_flags=True)
    return dr.alerts(dr.rolling(s, STREAM_ORDER, size=ref.window_size), ref)


@query(
    "drift_status",
    group="D",
    oracle=_dsql(
        f"""select true as enabled, 100 as window_size, 30 as min_window_size, (al.pos + 1)::bigint as total_observations,
  al.window_observations::bigint as window_observations, round(al.score, 6) as last_sample_score, al.rolling_score as rolling_drift_score,
  round(thr.sample_threshold, 6) as sample_alert_threshold, round(thr.window_threshold, 6) as window_alert_threshold,
  al.sample_alert or al.window_alert as alert_active,
  case when al.window_alert then '{dr.REASON_WINDOW}' when al.sample_alert then '{dr.REASON_SAMPLE}' end as alert_reason,
  (select string_agg(feature, ',' order by rank) from top where rank <= 5) as top_features
from al, thr where al.pos = (select max(pos) from al)""",
        _STREAM, _ROLL, _ALERT, _TOP_SQL,
    ),
)
def q_drift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_status(spark, sf_dir)


def drift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: which recent records leave the normal profile, and is the
    alert on? One status row for the end of the monitored stream."""
    _, _, ref = reference(spark, sf_dir)
    r = _rolled_with_flags(spark, sf_dir)  # one positioning of the stream serves both
    last = r.filter(F.col("pos") == F.col("stream_rows") - 1)
    top = dr.top_features(_last_window_ratios(spark, sf_dir, r), ref.features)
    names = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]), ",").alias("top_features"))
    st = last.select(
        F.lit(True).alias("enabled"),
        F.lit(ref.window_size).alias("window_size"),
        F.lit(ref.min_window_size).alias("min_window_size"),
        F.col("total_observations").cast("long").alias("total_observations"),
        F.col("window_observations").cast("long").alias("window_observations"),
        r6("score").alias("last_sample_score"),
        F.col("rolling_score").alias("rolling_drift_score"),
        r6(F.lit(ref.sample_threshold)).alias("sample_alert_threshold"),
        r6(F.lit(ref.window_threshold)).alias("window_alert_threshold"),
        "alert_active",
        "alert_reason",
    )
    # both sides hold exactly one row: equi-join on a constant key
    top_names = names.select(F.lit(1).alias("_k"), F.when(F.col("top_features") == "", None).otherwise(F.col("top_features")).alias("top_features"))
    return st.withColumn("_k", F.lit(1)).join(top_names, "_k").drop("_k")


@query(
    "drift_rising_edges",
    group="D",
    oracle=_dsql(
        """select count_if(a and not coalesce(p, false))::bigint as rising_edges, count_if(a)::bigint as active_rows from (
  select sample_alert or window_alert as a, lag(sample_alert or window_alert) over (order by pos) as p from al) x""",
        _STREAM, _ROLL, _ALERT,
    ),
)
def q_drift_rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = rolled(spark, sf_dir)
    return dr.rising_edges(r)


@query("drift_stream", group="D")
def q_drift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming run of the keyed monitor (parity with
    ``rolling_drift_keyed``); stateful, so rows-only."""
    from ..streaming import drift_stream as ds

    prep, fin, ref = reference(spark, sf_dir)
    src = fin.filter(F.col("split") == "test").select("sample_id", "ts", "service", *ref.features)
    out = ds.run(spark, src, ref, key="service")
    return out.select("sample_id", "service", "pos", "rolling_score", "window_observations")

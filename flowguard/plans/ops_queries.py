"""Registered queries: alerts (L1–L10), operational metrics (O1–O8), review
queue and labels (R1–R10) and the registry (R11–R15, E17, L3) over the
``requests`` log, the drift stream and the evaluation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import r6
from ..operators import alerts as al
from ..operators import review as rv
from ..sources import fixtures
from ..sources.fixtures import with_views
from . import drift_queries as dq
from . import eval_queries as eq
from .registry import query

_REQ_W = """r as (select * from requests where endpoint not in ('/metrics', '/health')),
w as (select seq, ts, count(*) over w as window_n, sum(case when http_status >= 400 then 1 else 0 end) over w as errors,
  list_sort(list(duration) over w) as durs from r window w as (order by seq rows between 49 preceding and current row)),
wa as (select seq, ts, window_n, errors, errors::double / window_n as error_rate,
  case when window_n >= 10 then durs[cast(round_even((window_n - 1) * 0.95, 0) as integer) + 1] end as p95_latency,
  window_n >= 10 as evaluated from w),
wb as (select *, evaluated and error_rate >= 0.30 as error_rate_alert, evaluated and p95_latency >= 3.0 as latency_alert from wa)"""


def _rsql(body: str, *ctes: str) -> str:
    return with_views("with " + ",\n".join([_REQ_W, *ctes]) + "\n" + body, "requests")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.request_windows(fixtures.requests(spark, sf_dir))


@query(
    "error_rate_window",
    group="L",
    oracle=_rsql("select seq, window_n::bigint as window_n, errors::bigint as errors, error_rate, error_rate_alert from wb"),
)
def q_error_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return w.select("seq", F.col("window_n").cast("long").alias("window_n"), F.col("errors").cast("long").alias("errors"), "error_rate", "error_rate_alert")


@query("latency_p95_window", group="L", oracle=_rsql("select seq, p95_latency, latency_alert from wb"))
def q_latency_p95_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("seq", "p95_latency", "latency_alert")


_COOLDOWN_ORACLE = with_views(
    """with recursive ev as (select source_id as k, epoch(date_trunc('second', ts))::bigint as t from requests where http_status >= 400),
s(k, t) as (select k, min(t) from ev group by k
  union all select s.k, (select min(e.t) from ev e where e.k = s.k and e.t >= s.t + 86400) from s where s.t is not null)
select k as source_id, t from s where t is not null""",
    "requests",
)


@query("alert_cooldown", group="L", oracle=_COOLDOWN_ORACLE)
def q_alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cooldown of one day per source over failed requests."""
    r = fixtures.requests(spark, sf_dir, failed_only=True)
    return al.cooldown(r, "source_id", "ts", seconds=86_400)


# operational alert history: triggers from the request windows, 300 s cooldown per key
_ACT = """act as (select seq, ts, k as key, fire, case when fire then 'trigger' else 'resolve' end as action, window_n, errors, error_rate, p95_latency from (
  select seq, ts, 'operational_http_error_rate' as k, error_rate_alert as fire, window_n, errors, error_rate, p95_latency from wb where evaluated
  union all select seq, ts, 'operational_high_latency', latency_alert, window_n, errors, error_rate, p95_latency from wb where evaluated) u)"""
_SENT = """trg as (select key, epoch(date_trunc('second', ts))::bigint as t, min(seq) as seq from act where action = 'trigger' group by key, t),
s(key, t) as (select key, min(t) from trg group by key
  union all select s.key, (select min(e.t) from trg e where e.key = s.key and e.t >= s.t + 300) from s where s.t is not null),
sent as (select trg.* from trg join s on trg.key = s.key and trg.t = s.t)"""


def _hsql(body: str) -> str:
    return with_views("with recursive " + ",\n".join([_REQ_W, _ACT, _SENT]) + "\n" + body, "requests")


def _history(spark: SparkSession, sf_dir: str):
    acts = al.alert_actions(_windows(spark, sf_dir))
    trg = acts.filter(F.col("action") == "trigger").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    sends = al.cooldown(trg, "key", "ts", seconds=al.COOLDOWN_SECONDS)
    first = trg.groupBy("key", "t").agg(F.min("seq").alias("seq"))
    sent = first.join(sends, ["key", "t"], "inner")
    # the sent trigger of a second is its first one; attach its row
    sent = sent.join(trg.drop("t"), ["key", "seq"], "inner")
    return acts, sent


@query("alert_history", group="L", oracle=_hsql("select key, t, seq::bigint as seq from sent"))
def q_alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sent = _history(spark, sf_dir)
    return sent.select("key", "t", F.col("seq").cast("long").alias("seq"))


@query(
    "active_alerts",
    group="L",
    oracle=_hsql(
        """select key, seq::bigint as seq, 'operational' as category, 'warning' as severity,
  not exists (select 1 from sent where sent.key = l.key and sent.seq = l.seq) as cooldown_active
from (select key, arg_max(seq, seq) as seq, arg_max(action, seq) as action from act group by key) l where action = 'trigger'"""
    ),
)
def q_active_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts, sent = _history(spark, sf_dir)
    last = acts.groupBy("key").agg(F.max_by(F.struct("seq", "action", "category", "severity"), F.col("seq")).alias("l")).select("key", "l.*")
    s = sent.select("key", "seq", F.lit(True).alias("_sent"))
    j = last.filter(F.col("action") == "trigger").join(s, ["key", "seq"], "left")
    return j.select("key", F.col("seq").cast("long").alias("seq"), "category", "severity",
                    (~F.coalesce(F.col("_sent"), F.lit(False))).alias("cooldown_active"))


@query("recent_alerts", group="L", oracle=_hsql("select key, seq::bigint as seq, t from sent order by seq desc, key limit 20"))
def q_recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sent = _history(spark, sf_dir)
    n = 20
    if not 1 <= n <= 200:
        raise ValueError("limit must be in 1..200")
    # newest N events: a top-N report (bounded by N)
    return sent.orderBy(F.col("seq").desc(), "key").limit(n).select("key", F.col("seq").cast("long").alias("seq"), "t")


@query(
    "alert_counts",
    group="L",
    oracle=_hsql("select 'operational' as category, 'warning' as severity, key, count(*)::bigint as n from sent group by key"),
)
def q_alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sent = _history(spark, sf_dir)
    return sent.groupBy("category", "severity", "key").agg(F.count(F.lit(1)).cast("long").alias("n"))


_TITLE = {al.KEY_ERROR_RATE: "share of failed requests is high", al.KEY_LATENCY: "requests are slow"}


def _msg_sql() -> str:
    title = f"case when key = '{al.KEY_ERROR_RATE}' then '{_TITLE[al.KEY_ERROR_RATE]}' else '{_TITLE[al.KEY_LATENCY]}' end"
    meta = """'{"window_size": ' || window_n::varchar || ', "errors": ' || errors::varchar || '}'"""
    lines = f"""'{al.MESSAGE_HEADER}' || chr(10) || 'severity: warning' || chr(10) || 'key: ' || key || chr(10) || 'category: operational' || chr(10)
  || 'title: ' || {title} || chr(10) || 'detail: window ' || window_n::varchar || chr(10) || 'time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S')"""
    return _hsql(
        f"""select seq::bigint as seq, length(msg)::bigint as length, md5(msg) as digest from (
  select a.seq, {lines} || chr(10) || chr(10) || 'metadata:' || chr(10) || {meta} as msg from sent join act a using (key, seq)) x"""
    )


@query("alert_message", group="L", oracle=_msg_sql())
def q_alert_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sent = _history(spark, sf_dir)
    fields = {
        "severity": F.col("severity"),
        "key": F.col("key"),
        "category": F.col("category"),
        "title": F.when(F.col("key") == al.KEY_ERROR_RATE, _TITLE[al.KEY_ERROR_RATE]).otherwise(_TITLE[al.KEY_LATENCY]),
        "detail": F.concat(F.lit("window "), F.col("window_n").cast("string")),
        "time": F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss"),
    }
    meta = F.concat(F.lit('{"window_size": '), F.col("window_n").cast("string"), F.lit(', "errors": '), F.col("errors").cast("string"), F.lit("}"))
    msg = al.message(fields, meta)
    return sent.select(F.col("seq").cast("long").alias("seq"), F.length(msg).cast("long").alias("length"), F.md5(msg).alias("digest"))


@query("alert_channels", group="L", oracle=_hsql("select key, seq::bigint as seq, 'local_history' as channels from sent"))
def q_alert_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No chat credentials are configured: the local history only."""
    _, sent = _history(spark, sf_dir)
    ch = al.alert_channels(F.lit(None).cast("string"), F.lit(None).cast("string"))
    return sent.select("key", F.col("seq").cast("long").alias("seq"), F.array_join(ch, ",").alias("channels"))


# ---------------------------------------------------------------------------
# operational metrics
# ---------------------------------------------------------------------------


@query(
    "request_counts",
    group="O",
    oracle=with_views(
        "select method, endpoint, cast(http_status as varchar) as http_status, count(*)::bigint as n from requests where endpoint not in ('/metrics', '/health') group by all",
        "requests",
    ),
)
def q_request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.requests(spark, sf_dir).filter(~F.col("endpoint").isin(*al.INTERNAL_ENDPOINTS))
    return r.groupBy("method", "endpoint", F.col("http_status").cast("string").alias("http_status")).agg(F.count(F.lit(1)).cast("long").alias("n"))


# Latency histogram bucket bounds (seconds) of the metrics library.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


@query(
    "latency_histogram",
    group="O",
    oracle=with_views(
        "select endpoint, le, count_if(duration <= le)::bigint as n from requests, (select unnest(["
        + ", ".join(f"{b}::double" for b in BUCKETS)
        + ", 'infinity'::double]) as le) b where endpoint not in ('/metrics', '/health') group by endpoint, le",
        "requests",
    ),
)
def q_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative bucket counts: one pass, each bucket a conditional count."""
    r = fixtures.requests(spark, sf_dir).filter(~F.col("endpoint").isin(*al.INTERNAL_ENDPOINTS))
    bounds = BUCKETS + [float("inf")]
    g = r.groupBy("endpoint").agg(*[F.count_if(F.col("duration") <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)])
    stack = ", ".join(f"cast({'double(\"inf\")' if b == float('inf') else repr(b)} as double), b{i}" for i, b in enumerate(bounds))
    return g.selectExpr("endpoint", f"stack({len(bounds)}, {stack}) as (le, n)").withColumn("n", F.col("n").cast("long"))


@query(
    "latency_sum_count",
    group="O",
    oracle=with_views(
        "select endpoint, round(sum(duration), 4) as total_seconds, count(*)::bigint as n from requests where endpoint not in ('/metrics', '/health') group by endpoint",
        "requests",
    ),
)
def q_latency_sum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.requests(spark, sf_dir).filter(~F.col("endpoint").isin(*al.INTERNAL_ENDPOINTS))
    # summed as decimal so the total does not depend on the summation order
    return r.groupBy("endpoint").agg(F.round(F.sum(F.col("duration").cast("decimal(20,6)")).cast("double"), 4).alias("total_seconds"),
                                     F.count(F.lit(1)).cast("long").alias("n"))


@query(
    "predictions_by_class",
    group="O",
    oracle=with_views("select model, pred_type, count(*)::bigint as n from preds group by rollup (model, pred_type)", "preds"),
)
def q_predictions_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.preds(spark, sf_dir)
    return p.rollup("model", "pred_type").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query(
    "request_rate",
    group="O",
    oracle=with_views(
        """select epoch(time_bucket(interval 1 minute, ts))::bigint as window_start, endpoint, count(*)::bigint as n, count(*) / 60.0::double as rate_per_second
from requests where endpoint not in ('/metrics', '/health') group by all""",
        "requests",
    ),
)
def q_request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.requests(spark, sf_dir).filter(~F.col("endpoint").isin(*al.INTERNAL_ENDPOINTS))
    g = r.groupBy(F.window("ts", "1 minute").alias("w"), "endpoint").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return g.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "endpoint", "n", (F.col("n") / 60.0).alias("rate_per_second"))


@query(
    "latency_summary",
    group="O",
    oracle=with_views(
        """select count_if(http_status < 400)::bigint as ok, count_if(http_status >= 400)::bigint as errors,
  round(avg(duration), 6) as mean_latency, max(duration) as max_latency from requests""",
        "requests",
    ),
)
def q_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.requests(spark, sf_dir)
    return r.agg(F.count_if(F.col("http_status") < 400).cast("long").alias("ok"), F.count_if(F.col("http_status") >= 400).cast("long").alias("errors"),
                 r6(F.avg("duration")).alias("mean_latency"), F.max("duration").alias("max_latency"))


# ---------------------------------------------------------------------------
# review queue and labels
# ---------------------------------------------------------------------------

_Q = ["review_queue", "validated", "submissions"]


@query(
    "enqueue_review",
    group="R",
    oracle=dq._dsql(
        f"""select al.sample_id, (al.pos // 4)::bigint as batch_id, coalesce(l.reason, 'sample_out_of_profile') as review_reason from al join (
  select pos // 4 as b, arg_max(case when window_alert then '{dq.dr.REASON_WINDOW}' when sample_alert then '{dq.dr.REASON_SAMPLE}' end, pos) as reason,
    arg_max(sample_alert or window_alert, pos) as active, arg_max(score, pos) as last_score from al, thr group by 1) l on al.pos // 4 = l.b
where l.active or l.last_score >= (select sample_threshold from thr)""",
        dq._STREAM, dq._ROLL, dq._ALERT,
    ),
)
def q_enqueue_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, ref = dq.rolled(spark, sf_dir)
    b = r.withColumn("batch_id", F.floor(F.col("pos") / 4).cast("long"))
    q = rv.enqueue(b, "batch_id", "pos", ref.sample_threshold, mode="batch")
    return q.select("sample_id", "batch_id", "review_reason")


@query(
    "prediction_log",
    group="R",
    oracle=dq._dsql(
        """select (pos // 4)::bigint as batch_id, count(*)::bigint as n_rows, string_agg(sample_id, ',' order by pos) as inputs,
  round(avg(score), 6) as mean_score, arg_max(sample_alert or window_alert, pos) as alert_active from al group by 1""",
        dq._STREAM, dq._ROLL, dq._ALERT,
    ),
)
def q_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = dq.rolled(spark, sf_dir)
    b = r.withColumn("batch_id", F.floor(F.col("pos") / 4).cast("long"))
    return rv.prediction_log(b, "batch_id", "pos")


@query(
    "pending_reviews",
    group="R",
    oracle=with_views(
        "select sample_id, seq from review_queue q where not exists (select 1 from validated v where v.sample_id = q.sample_id) order by seq desc limit 500",
        *_Q,
    ),
)
def q_pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.pending(fixtures.review_queue(spark, sf_dir), fixtures.validated(spark, sf_dir), limit=500).select("sample_id", "seq")


@query(
    "pending_count",
    group="R",
    oracle=with_views(
        "select count(*)::bigint as pending from review_queue q where not exists (select 1 from validated v where v.sample_id = q.sample_id)", *_Q
    ),
)
def q_pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.pending_count(fixtures.review_queue(spark, sf_dir), fixtures.validated(spark, sf_dir))


_CLASSES = "classes as (select distinct class1 as label from flows)"


@query(
    "apply_labels",
    group="R",
    oracle=with_views(
        f"""with {_CLASSES}, s as (select *, lower(trim(validated_label)) as lbl,
  row_number() over (partition by sample_id order by submit_seq) as rn from submissions)
select submit_seq, sample_id, case
  when not exists (select 1 from review_queue q where q.sample_id = s.sample_id) then 'unknown_id'
  when rn > 1 or exists (select 1 from validated v where v.sample_id = s.sample_id) then 'already_validated'
  when lbl not in (select label from classes) then 'unknown_label' else 'approved' end as verdict,
  case when lbl in (select label from classes) then lbl end as label from s""",
        *_Q, "flows",
    ),
)
def q_apply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch_path

    # the classes are read twice (their number, then the join): found once, one row per class
    path = scratch_path(spark, "classes")
    fixtures.flow_labels(spark, sf_dir).select(F.col("class1").alias("label")).distinct().write.parquet(path)
    v = rv.apply_labels(fixtures.submissions(spark, sf_dir), fixtures.review_queue(spark, sf_dir), fixtures.validated(spark, sf_dir), spark.read.parquet(path))
    return v.select("submit_seq", "sample_id", "verdict", "label")


@query(
    "approved_samples",
    group="R",
    oracle=with_views("select sample_id, seq, validated_label from validated where review_status = 'approved' and validated_label <> '' and duration is not null", *_Q),
)
def q_approved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.approved(fixtures.validated(spark, sf_dir), input_col="duration").select("sample_id", "seq", "validated_label")


@query(
    "retrain_gate",
    group="R",
    oracle=with_views(
        """select n::bigint as approved, n >= 50 as run, case when n >= 50 then 'run' else 'skipped' end as decision from (
  select count(*) as n from validated where review_status = 'approved' and validated_label <> '' and duration is not null) x""",
        *_Q,
    ),
)
def q_retrain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.retrain_gate(rv.approved(fixtures.validated(spark, sf_dir), input_col="duration"), minimum=50)


@query(
    "retrain_trigger",
    group="R",
    oracle=dq._dsql(
        """select b::bigint as batch_id, reason, batches::bigint as batches, seconds::bigint as seconds from fired""",
        dq._STREAM, dq._ROLL, dq._ALERT,
        """bt as (select pos // 4 as b, coalesce(arg_max(sample_alert or window_alert, pos), false) as active, epoch(max(ts)) as t from al group by 1)""",
        """fired as (
  select * from (select b, t, case when b + 1 >= 1000 then 'batches' when active then 'drift' else 'interval' end as reason, b + 1 as batches, t - t0 as seconds
    from bt, (select min(t) as t0 from bt) x where b + 1 >= 1000 or active or t - t0 >= 3600 order by b limit 1) first_one
  union all
  select n.b, n.t, n.reason, n.b - f.b, n.t - f.t from fired f, lateral (
    select b, t, case when b - f.b >= 1000 then 'batches' when active then 'drift' else 'interval' end as reason
    from bt where b > f.b and (b - f.b >= 1000 or active or t - f.t >= 3600) order by b limit 1) n)""",
    ).replace("with ", "with recursive ", 1),
)
def q_retrain_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trigger of the log, batches of four rows; the clock of a batch is
    its last time."""
    r, _ = dq.rolled(spark, sf_dir)
    b = r.groupBy(F.floor(F.col("pos") / 4).cast("long").alias("batch_id")).agg(
        F.max_by("alert_active", "pos").alias("active"), F.max("ts").alias("ts"))
    return rv.retrain_triggers(b, "batch_id", "ts", "active")


@query(
    "merge_training",
    group="R",
    oracle=with_views(
        """select source, label, count(*)::bigint as n, round(sum(duration), 4) as duration_sum from (
  select 'train' as source, class1 as label, 0.0::double as duration from flows where split = 'train'
  union all select 'review', validated_label, duration from validated where review_status = 'approved' and validated_label <> '' and duration is not null) u
group by all""",
        *_Q, "flows",
    ),
)
def q_merge_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fixtures.flows(spark, sf_dir).filter(F.col("split") == "train").select(F.col("class1").alias("label"))
    appr = rv.approved(fixtures.validated(spark, sf_dir), input_col="duration")
    m = rv.merge_training(train, appr, ["duration"], label="label")
    return m.groupBy("source", "label").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                            F.round(F.sum(F.col("duration").cast("decimal(20,6)")).cast("double"), 4).alias("duration_sum"))


@query(
    "archive_processed",
    group="R",
    oracle=with_views(
        """select sample_id, seq from validated v where not exists (select 1 from validated p where p.review_status = 'approved' and p.validated_label <> ''
  and p.duration is not null and p.sample_id is not distinct from v.sample_id)""",
        *_Q,
    ),
)
def q_archive_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.validated(spark, sf_dir)
    processed = rv.approved(v, input_col="duration")
    return rv.archive(v, processed).select("sample_id", "seq")


@query(
    "review_progress",
    group="O",
    oracle=with_views(
        """select *, validated * 100.0::double / minimum as progress_percent from (
  select (select count(*) from review_queue q where not exists (select 1 from validated v where v.sample_id = q.sample_id))::bigint as pending,
  (select count(*) from validated where review_status = 'approved' and validated_label <> '' and duration is not null)::bigint as validated,
  50 as minimum) x""",
        *_Q,
    ),
)
def q_review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = fixtures.review_queue(spark, sf_dir), fixtures.validated(spark, sf_dir)
    return rv.progress(q, v, minimum=50)


# ---------------------------------------------------------------------------
# registry (versions derived from the evaluation of the pseudo-models)
# ---------------------------------------------------------------------------

_REG_SQL = [
    *eq._SCORES_CTES[:-1],
    eq._SCORES_CTES[-1],
    """acc as (select model, split, avg(case when true_type = pred_type then 1.0 else 0.0 end) as accuracy from d group by model, split)""",
    """wt as (select model, split, sum(f1 * support) / sum(support) as f1_weighted from rep2 group by model, split)""",
    """reg as (select 'RF_v' || cast(row_number() over (order by s.model, s.split) as varchar) as version, row_number() over (order by s.model, s.split) as vnum,
  acc.accuracy, s.f1_type as f1_macro, wt.f1_weighted from scores s join acc using (model, split) join wt using (model, split))""",
]


def _regsql(body: str, *extra: str) -> str:
    return eq._sql(body, *_REG_SQL[:-3], eq._REPORT_CTE, *_REG_SQL[-3:], *extra)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    scores = eq._scores(spark, sf_dir)
    d = eq._derived(spark, sf_dir)
    return rg.registry_from_scores(scores, d)


@query("model_compare", group="E", oracle=_regsql("select version, round(accuracy, 6) as accuracy, round(f1_macro, 6) as f1_macro, round(f1_weighted, 6) as f1_weighted from reg"))
def q_model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registry(spark, sf_dir)
    return r.select("version", r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"), r6("f1_weighted").alias("f1_weighted"))


@query("model_quality_alert", group="L", oracle=_regsql("select version, 'critical' as severity, round(f1_macro, 6) as f1_macro from reg where f1_macro < 0.90"))
def q_model_quality_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    return rg.quality_alerts(_registry(spark, sf_dir), al.F1_MACRO_MIN).select("version", "severity", r6("f1_macro").alias("f1_macro"))


@query("next_version", group="R", oracle=_regsql("select 'RF_v' || cast(coalesce(max(vnum), 0) + 1 as varchar) as next_version from reg"))
def q_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    return rg.next_version(_registry(spark, sf_dir))


@query("list_models", group="R", oracle=_regsql("select version, vnum::bigint as ordinal from reg"))
def q_list_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    return rg.list_models(_registry(spark, sf_dir)).select("version", "ordinal")


_AUDIT = """asked as (select seq, 'RF_v' || cast(1 + source_id % 12 as varchar) as version from requests),
known as (select seq, asked.version, reg.version is not null as ok from asked left join reg on reg.version = asked.version),
audit as (select seq, last_value(case when ok then version end ignore nulls) over (order by seq rows between unbounded preceding and 1 preceding) as previous_model,
  version as new_model, case when ok then 'success' else 'failed' end as status from known),
active as (select arg_max(new_model, seq) as version from audit where status = 'success')"""


def _auditsql(body: str) -> str:
    return with_views(_regsql(body, _AUDIT), "requests")


def _written_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, evaluated once: one row per version."""
    from ..session import scratch_path

    path = scratch_path(spark, "registry")
    _registry(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def _audit(spark: SparkSession, sf_dir: str, reg: DataFrame | None = None) -> DataFrame:
    """The audit log after the selection requests came in two batches. A
    request names a version (stand-in: one of twelve by the request's source).
    ``reg`` is the written registry of a caller that reads it too."""
    from ..operators import registry as rg
    from ..session import scratch_path

    base = scratch_path(spark, "model-audit")
    asked = fixtures.requests(spark, sf_dir).select("seq", F.concat(F.lit("RF_v"), (F.col("source_id") % 12 + 1).cast("string")).alias("version"))
    half = asked.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    reg = _written_registry(spark, sf_dir) if reg is None else reg
    for batch in (F.col("seq") <= F.lit(half), F.col("seq") > F.lit(half)):
        rg.select_versions(asked.where(batch), reg, base)
    return rg.audit(spark, base)


@query("select_model", group="R", oracle=_auditsql("select seq::bigint as seq, previous_model, new_model, status from audit"))
def q_select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audit(spark, sf_dir)
    return a.select(F.col("seq").cast("long").alias("seq"), "previous_model", "new_model", "status")


@query("model_history", group="R", oracle=_auditsql("select seq::bigint as seq, new_model, status from audit order by seq desc limit 20"))
def q_model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    return rg.history(_audit(spark, sf_dir), 20).select(F.col("seq").cast("long").alias("seq"), "new_model", "status")


@query(
    "model_summary",
    group="R",
    oracle=_auditsql(
        "select reg.version, round(accuracy, 6) as accuracy, round(f1_macro, 6) as f1_macro, round(f1_weighted, 6) as f1_weighted from reg join active using (version)",
    ),
)
def q_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    reg = _written_registry(spark, sf_dir)
    s = rg.summary(reg, _audit(spark, sf_dir, reg))
    return s.select("version", r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"), r6("f1_weighted").alias("f1_weighted"))


@query(
    "latest_retrain_status",
    group="O",
    oracle=_auditsql(
        """select (status = 'success')::int as success, (status = 'skipped')::int as skipped, (status = 'failed')::int as failed
from audit where seq = (select max(seq) from audit)""",
    ),
)
def q_latest_retrain_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    return rg.last_status_flags(_audit(spark, sf_dir))


@query(
    "active_model_flag",
    group="O",
    oracle=_auditsql("select reg.version, case when reg.version = active.version then 1 else 0 end as active from reg left join active on true"),
)
def q_active_model_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import registry as rg

    reg = _written_registry(spark, sf_dir)
    return rg.active_flags(reg, _audit(spark, sf_dir, reg))


# ---------------------------------------------------------------------------
# per-source request windows: batch (with oracle) and streaming (parity)
# ---------------------------------------------------------------------------


@query(
    "error_rate_window_keyed",
    group="L",
    oracle=with_views(
        """with r as (select * from requests where endpoint not in ('/metrics', '/health')),
w as (select seq, source_id, count(*) over w as window_n, sum(case when http_status >= 400 then 1 else 0 end) over w as errors,
  list_sort(list(duration) over w) as durs from r window w as (partition by source_id order by seq rows between 49 preceding and current row))
select seq, source_id, window_n::bigint as window_n, errors::bigint as errors, errors::double / window_n as error_rate,
  case when window_n >= 10 then durs[cast(round_even((window_n - 1) * 0.95, 0) as integer) + 1] end as p95_latency from w""",
        "requests",
    ),
)
def q_error_rate_window_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = al.request_windows(fixtures.requests(spark, sf_dir), partition_by=["source_id"])
    return w.select("seq", "source_id", F.col("window_n").cast("long").alias("window_n"), F.col("errors").cast("long").alias("errors"),
                    "error_rate", "p95_latency")


@query("alert_stream", group="L")
def q_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming per-source request windows (stateful; rows-only, parity
    with ``error_rate_window_keyed``)."""
    from ..streaming import alert_stream as ast

    return ast.alert_stream(spark, fixtures.requests(spark, sf_dir))


@query(
    "active_alerts_stream",
    group="L",
    oracle=with_views(
        """with r as (select * from requests where endpoint not in ('/metrics', '/health')),
w as (select seq, source_id, count(*) over w as window_n, sum(case when http_status >= 400 then 1 else 0 end) over w as errors,
  list_sort(list(duration) over w) as durs from r window w as (partition by source_id order by seq rows between 49 preceding and current row)),
l as (select *, durs[cast(round_even((window_n - 1) * 0.95, 0) as integer) + 1] as p95 from w
  where window_n >= 10 qualify row_number() over (partition by source_id order by seq desc) = 1)
select 'error_rate' as alert, source_id, seq from l where errors::double / window_n >= 0.30
union all select 'latency', source_id, seq from l where p95 >= 3.0""",
        "requests",
    ),
)
def q_active_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that are active when the stream of all requests has been read."""
    from ..streaming import alert_stream as ast

    _, state = ast.run(spark, fixtures.requests(spark, sf_dir))
    return ast.active_alerts(spark, state).select("alert", "source_id", "seq")


@query(
    "request_rate_stream",
    group="O",
    oracle=with_views(
        """select epoch(time_bucket(interval 1 minute, ts))::bigint as window_start, endpoint, count(*)::bigint as n, count(*) / 60.0::double as rate_per_second
from requests where endpoint not in ('/metrics', '/health') group by all""",
        "requests",
    ),
)
def q_request_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per minute counted on the stream."""
    from ..streaming import alert_stream as ast

    return ast.rate_stream(spark, fixtures.requests(spark, sf_dir))


ARRIVALS = 4  # parts in which the stand-in stream below arrives, each with rows of all times
LATE_SECONDS = 600


@query(
    "request_rate_late_stream",
    group="O",
    oracle=with_views(
        """select epoch(time_bucket(interval 1 minute, ts))::bigint as window_start, endpoint, count(*)::bigint as n, count(*) / 60.0::double as rate_per_second
from requests where endpoint not in ('/metrics', '/health') group by all""",
        "requests",
    ),
)
def q_request_rate_late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per minute on a stream whose rows come out of order, with a
    watermark of ten minutes: rows in time and late rows added up."""
    from ..session import scratch_path
    from ..streaming import late_rows as late
    from ..streaming.sources import write_batches

    src, requests = scratch_path(spark, "late-src"), fixtures.requests(spark, sf_dir)
    for part in range(ARRIVALS):
        schema = write_batches(requests.filter(F.pmod(F.xxhash64("seq"), F.lit(ARRIVALS)) == part), src, mode="append")
    counted = late.late_rates(spark, src, schema, LATE_SECONDS).counted()
    n = F.col("on_time") + F.col("late")
    return counted.select("window_start", "endpoint", n.alias("n"), (n / 60.0).alias("rate_per_second"))


@query("retrain_run", group="R")
def q_retrain_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate → merge → train → register → archive over the validated labels
    (model fitting: rows-only)."""
    from ..operators import registry as rg
    from ..operators import retrain
    from ..session import scratch_path
    from . import prep_queries as pq

    prep, fin = pq.final_features(spark, sf_dir)
    nv = rg.next_version(_registry(spark, sf_dir)).first()["next_version"]
    return retrain.run(spark, fin.filter(F.col("split") == "train"), fin.filter(F.col("split") == "test"), prep.features,
                       fixtures.validated(spark, sf_dir), nv, scratch_path(spark, "retrain"))
